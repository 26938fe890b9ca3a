"""Removal of repeated passages of lines (operator 2), in DataFrame functions only.

A rolling hash over the hashes of a line and the one before it ends a chunk where it is a least one among its
neighbours, so chunk borders follow the content, survive lines inserted elsewhere and leave no chunk of one line in a
text of two or more. Chunks whose hash occurs more than once are compared by their bytes, and all but the first of equal
ones (by doc_id, then place) are removed. A passage seldom starts and ends at borders, so a removed chunk is then
extended, line by line and by bytes, into the two chunks before and after it as far as those next to the first copy
agree: borders inside a passage, but for one near each edge, are the same in all of its copies, so its edges lie there.

Each removed line equals one that stands earlier, beside the first copy, so of every passage one copy stays. A passage
is found if two borders with the lines that decide on them fall into it: always some part of long ones, and seldom all
of it below four lines; the README has measured shares.

Scale: hashes of chunks are counted with map-side sums; documents' texts and the texts of repeated chunks are shuffled
once or twice. A chunk that very many documents share meets one row of the counts, so the join may be split.

Defined results: null texts stay null; an empty text is one empty line; texts of one line and chunks of blank lines
alone stay, unless a passage reaches over them; rows with the same doc_id and text count as one document and keep the
same lines; null doc_ids come first; other columns stay; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut

WINDOW, BASE, MODULUS, LEAST_LINES = 2, 31, 1_000_003, 2
#: Repeated hashes that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST = 2_000_000


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def rolled_hashes(hashes: Column, window: int = WINDOW) -> Column:
    """The rolling hash at each line, over it and the window - 1 lines before."""

    def rolled(h: Column, i: Column) -> Column:
        total = h
        for k in range(1, window):
            total = total + F.coalesce(F.get(hashes, i - k), F.lit(0)) * BASE**k
        return total % MODULUS

    return F.transform(hashes, rolled)


def chunk_ends(rolled: Column) -> Column:
    """The last lines of chunks: where the rolling hash is below that before and not above that after, but not so near
    an end of the text that one line would be left; and the end."""
    n = F.size(rolled)
    least = lambda h, i: (i > 0) & (i < n - 2) & (h < F.get(rolled, i - 1)) & (h <= F.get(rolled, i + 1))
    return F.filter(F.transform(rolled, lambda h, i: F.when(least(h, i) | (i == n - 1), i)), lambda i: i.isNotNull())


def chunks(docs: DataFrame) -> DataFrame:
    """doc, lines, first, last, chunk of each chunk that is not blank, and start and end: the first line of the two chunks
    before and the last of the two after. doc is the key of a document."""
    lined = docs.select("doc", "text").where("text IS NOT NULL").withColumn("lines", F.split("text", "\n")).where(F.size("lines") >= LEAST_LINES)
    # a column each: an expression that a lambda looks into would be computed anew for each line
    lined = lined.withColumn("hashes", F.transform("lines", line_hash)).withColumn("rolled", rolled_hashes(F.col("hashes"))).withColumn("ends", chunk_ends(F.col("rolled")))
    at = lambda k: F.coalesce(F.get(F.col("ends"), k), F.lit(-1)) + 1
    last = F.size("lines") - 1
    spans = F.transform(
        "ends",
        lambda e, k: F.struct(at(k - 1).alias("first"), e.alias("last"), at(k - 3).alias("start"), F.coalesce(F.get(F.col("ends"), k + 2), last).alias("end")),
    )
    flat = lined.select("doc", "lines", F.explode(spans).alias("s")).select("doc", "lines", "s.*")
    flat = flat.withColumn("chunk", chunk_text(F.col("lines"), F.col("first"), F.col("last")))
    return flat.where(F.col("chunk").rlike(r"\S"))


def chunk_text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def equal_lines(a: Column, b: Column) -> Column:
    """How many lines two arrays share from their starts on."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, F.lit(1), n), lambda line, i: line == F.get(b, i))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, n).cast("int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, spans, chunks: the distinct (first, last) of lines that occur earlier and the number of removed chunks, one
    row for each document that has any.

    Only hashes of chunks are shuffled to count them. Hashes that repeat, if they are few, are broadcast to the chunks,
    so only repeated chunks and the lines beside them are shuffled; if they are many, the chunks are joined to them by a shuffle.
    """
    def beside(rows: DataFrame) -> DataFrame:
        """Instead of all lines, those of the chunks before, last first, and of the chunks after."""
        lines = F.col("lines")
        before = F.reverse(F.slice(lines, F.col("start") + 1, F.col("first") - F.col("start")))
        return rows.withColumn("before", before).withColumn("after", F.slice(lines, F.col("last") + 2, F.col("end") - F.col("last"))).drop("lines", "start", "end")

    found = chunks(docs).withColumn("hash", F.xxhash64("chunk"))
    seen = cut(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "line-hashes")
    few = seen.count() <= BROADCAST
    texts = cut(beside(found.join(F.broadcast(seen), "hash")) if few else beside(found).join(seen, "hash"), "line-chunks")
    # written, so that the join has a shuffle of its own on both sides and a chunk that very many documents share is split
    firsts = cut(texts.groupBy("hash", "chunk").agg(F.min(F.struct("doc", "first", "before", "after")).alias("kept")), "line-firsts")
    later = texts.join(firsts, ["hash", "chunk"]).where(F.struct("doc", "first") != F.struct("kept.doc", "kept.first"))
    first = F.col("first") - equal_lines(F.col("before"), F.col("kept.before"))
    last = F.col("last") + equal_lines(F.col("after"), F.col("kept.after"))
    later = later.select("doc", first.alias("first"), last.alias("last"), F.col("first").alias("chunk"))
    return later.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.size(F.collect_set("chunk")).alias("chunks"))


def drop_repeated_lines(df: DataFrame) -> DataFrame:
    """df with repeated chunks cut out of its text, and the columns n_lines, n_removed (lines), n_chunks (removed)."""
    text = F.col("text").cast("string")
    doc = F.struct(F.col("doc_id"), F.xxhash64(text).alias("mark")).alias("doc")
    found = repeated_spans(df.select(doc, text.alias("text")))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"])
    out = df.select(doc, text.alias("text"), row.alias("row")).join(found, "doc", "left").withColumn("lines", F.split("text", "\n"))
    removed = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    out = out.withColumn("removed", F.coalesce(removed, F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    cut_text = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    out = out.withColumn("kept", F.when(F.size("removed") > 0, cut_text).otherwise(F.col("text")))
    names = [F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in df.columns if c not in ("n_lines", "n_removed", "n_chunks")]
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return out.select(*names, lines.cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.coalesce("chunks", F.lit(0)).cast("long").alias("n_chunks"))
