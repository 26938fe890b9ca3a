"""Order MinHash fingerprints (operator 8), in DataFrame functions only.

The k-mers of a text are runs of five words, each numbered by its occurrence. Their hashes stand on a ring; from each
of SKETCHES fixed points of it the next TUPLE hashes are taken, put back in the order of the text, and hashed as one
tuple. Two texts share a tuple only if they share its k-mers in the same order, so the share of equal tuples falls with
the edit distance, also where the sets of words stay the same.

Occurrences are counted by the whole 64-bit hashes of k-mers. On the ring a numbered k-mer keeps the upper 34 bits of
its hash, and its place in the text takes the lower 30, so one sort of an array of longs orders by hash and one more by
place. A text of Spark is shorter than 2**31 bytes, so it has at most 2**30 words, and places never wrap.

Defined results: a null text is empty; an empty text, and one without words, has one k-mer, the empty one; a text of
fewer than five words has one k-mer, all its words. Other columns stay. Null doc_ids come before others; rows that
share a doc_id follow each other by a hash of the text; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WHITE, free_name, shuffle_partitions, text_or_empty

K, SKETCHES, TUPLE = 5, 32, 2
PLACE = 30
LOW = (1 << PLACE) - 1


def kmer_hashes(words: Column, k: int = K) -> Column:
    """The hash of each k-mer, in order; of all words if there are fewer than k."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.coalesce(F.get(words, i + j), F.lit(0)) for j in range(k)]))


def placed(hash_: Column, place: Column) -> Column:
    """Upper bits of a hash and a place, in one long."""
    return F.shiftleft(F.shiftright(hash_, PLACE), PLACE).bitwiseOR(place.bitwiseAND(F.lit(LOW)).cast("long"))


def fingerprint_of(df: DataFrame, text: Column, out: str, k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> DataFrame:
    """df with the column `out`, an array of `sketches` longs."""
    words = F.transform(F.filter(F.split(text, WHITE), lambda w: w != ""), lambda w: F.xxhash64(w))
    # columns of the caller's keep their names; the text may be one of them
    _words, _kmers, _pairs, _starts, _own, _ring, _all = (free_name(df, x) for x in ("words", "kmers", "pairs", "starts", "own", "ring", "all"))
    df = df.withColumn(_words, words).withColumn(_kmers, kmer_hashes(F.col(_words), k)).drop(_words)
    # only a text with equal k-mers needs them sorted: they then stand together, by place, and the rank in the run counts
    fresh = F.transform(_kmers, lambda x, i: placed(F.xxhash64(x, F.lit(0)), i))
    pairs = F.sort_array(F.transform(_kmers, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(_pairs, F.when(F.size(F.array_distinct(_kmers)) < F.size(_kmers), pairs))
    h = lambda i: F.get(F.col(_pairs), i)["h"]
    starts = F.filter(F.sequence(F.lit(0), F.size(_kmers) - 1), lambda i: (i == 0) | (h(i) != h(i - 1)))
    df = df.withColumn(_starts, F.when(F.col(_pairs).isNotNull(), starts))
    runs = F.transform(_starts, lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(F.col(_starts), j + 1), F.size(_pairs)) - s - 1))
    numbered = F.zip_with(_pairs, F.flatten(runs), lambda x, o: placed(F.xxhash64(x["h"], o), x["i"]))
    own = F.when(F.col(_pairs).isNull(), fresh).otherwise(numbered)
    points = [((j << 64) // sketches) - (1 << 63) for j in range(sketches)]
    # the fixed points are sorted in; before point j stand j points, so its place among the hashes is known
    marks = F.array(*[F.lit(p) for p in points])
    df = df.withColumn(_own, own).drop(_kmers, _pairs, _starts)
    df = df.withColumn(_ring, F.sort_array(_own)).withColumn(_all, F.sort_array(F.concat(_own, marks))).drop(_own)
    df = df.withColumn(_ring, F.concat(_ring, F.slice(_ring, 1, size)))
    n = F.size(_ring) - F.least(F.size(_all) - sketches, F.lit(size))

    def signature(p: Column, j: Column) -> Column:
        at = F.array_position(F.col(_all), p).cast("int") - 1 - j
        taken = F.slice(F.col(_ring), F.pmod(at, n) + 1, F.least(n, F.lit(size)))
        by_place = F.sort_array(F.transform(taken, lambda x: F.shiftleft(x, 64 - PLACE).bitwiseOR(F.shiftrightunsigned(x, PLACE))))
        return F.xxhash64(F.transform(by_place, lambda x: x.bitwiseAND(F.lit((1 << 64 - PLACE) - 1))))

    return df.withColumn(out, F.transform(marks, signature)).drop(_ring, _all)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def shown(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, F.hex), "-"))


def ranges(df: DataFrame, key: str, tie: Column, n: int) -> Column:
    """A number for each row that grows with (key, tie): about n ranges of equally many rows, however keys are spread.

    The bounds are at most n numbers, by approximate quantiles of the keys; rows without a key are dealt out by tie.
    """
    found = df.where(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted(set(found))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key).cast("double"))) if bounds else F.lit(0)
    return F.when(F.col(key).isNull(), F.shiftright(tie, 56).cast("int") - 128).otherwise(place)


def with_next(df: DataFrame, columns: list[str], key: str = "doc_id", n: int | None = None, made: Callable[[DataFrame], DataFrame] = lambda d: d, of: tuple[str, ...] = ()) -> DataFrame:
    """made(df) with the struct `_next` of columns, and of the columns `of` that made adds, in the row that follows by
    key; after the last row comes the first.

    Null keys come first; rows of one key are ordered by a hash of the columns. Rows are dealt out by n ranges of keys,
    four times the shuffle partitions if not given, so that their hashes fill tasks evenly, and ordered within each. The last row of a range takes the first row of
    the next one that has any; only one number for each range is ordered as a whole. The first rows are found by their
    keys alone, so made runs once for each row, and once more for the first row of each range.
    """
    tie = F.xxhash64(*columns)
    bucket = ranges(df, key, tie, n or 4 * shuffle_partitions(df.sparkSession))
    order = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), "_tie")
    dealt = df.withColumn("_tie", tie).withColumn("_bucket", bucket)
    following = F.struct(*columns, *of)
    rows = made(dealt).withColumn("_next", F.lead(following).over(order))
    firsts = dealt.groupBy("_bucket").agg(F.min(F.struct(F.col(key).alias("first"), F.col("_tie").alias("tie"))).alias("f")).select("_bucket", "f.first", "f.tie")
    # the number of the range before each; the first follows the last
    before = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))
    firsts = firsts.withColumn("_before", before).drop("_bucket")
    # one row for each range, at most n and 256 for rows without a key
    found = dealt.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("first")) & (F.col("_tie") == F.col("tie")))
    heads = made(found.select("_before", *columns).dropDuplicates(["_before"])).select(F.col("_before").alias("_bucket"), following.alias("_head"))
    out = rows.join(heads, "_bucket", "left")
    return out.withColumn("_next", F.coalesce("_next", "_head")).drop("_bucket", "_head", "_tie")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the start of the next document.

    One shuffle of texts, by ranges of doc_id; fingerprints are made before it and travel with the texts.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_next(rows, ["text"], made=lambda d: fingerprint_of(d, F.col("text"), "mark"), of=("mark",))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("_next.text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "mark", F.col("_next.mark").alias("next_mark"))
    rows = fingerprint_of(rows, F.col("edited"), "edited_mark")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("mark")).alias("fingerprint"), shown(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
