"""Removal of repeated byte strings by a sparse suffix array (operator 6).

A byte goes if a string of LENGTH bytes covers it that also starts earlier, in an earlier document or in the same one.
Every such string holds an anchor, a run of ANCHOR bytes whose hash is least among those in the string, and the copies
of a string have it at the same place. So only the suffixes at anchors that occur more than once are compared:

1. Documents are written once, bucketed by document, and anchors are found in them. Exact copies of a text that
   occurs earlier are covered whole and take no further part.
2. Anchors that occur once drop out. The surroundings of the others, all strings of LENGTH bytes that hold the
   anchor, are digested; those that occur earlier are covered whole, by one grouping.
3. The first of each distinct surroundings is a suffix of the array, with the bytes before it. Spark's sampled
   splitters range-partition suffixes by their leading bytes, so those that share an anchor meet in one bucket or
   in neighbouring sorted runs of it; a bucket is sorted by multikey quicksort, and the lengths of prefixes (and of
   endings, before the anchor) that neighbours share say which strings occur earlier.
4. An anchor with more suffixes than an even bucket holds is cut by splitters, and its copies lie on both sides of
   borders. It is compared across the borders, string by string: each string is dealt out by its bytes and grouped, with
   map-side minima, so no task holds more than its share of the suffixes, however frequent one anchor is.

Defined results: null texts are empty and have nothing to remove; where doc_ids repeat or are null, rows take numbers
in the order of doc_id (nulls first), a hash of the text, and the text, and count as documents of their own; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, new_folder, shuffle_partitions, text_or_empty

LENGTH, ANCHOR = 100, 16
#: Suffixes of one anchor that any task can compare.
TASK = 100_000
#: Repeated anchors that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST = 2_000_000
#: Suffixes that are compared at a time, if no anchor has more.
BATCH = 60_000


def _doubled(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of `width` values."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def run_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes; k is a power of two."""
    base, span = 0xD6E8FEB86659FD93, 1
    h = data.astype(np.uint64) + np.uint64(1)
    while span < k:
        h = h[:-span] * np.uint64(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text: runs with the least hash in some string of `length` bytes."""
    if len(raw) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    width = length - k + 1
    h = run_hashes(np.frombuffer(raw, dtype=np.uint8), k)
    least = _doubled(h, width, np.minimum)
    # the run at i is an anchor if it equals the greatest of the least hashes of the windows that hold it
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_doubled(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, h[at].view(np.int64)


def around(raw: bytes, at: int, length: int = LENGTH, k: int = ANCHOR) -> tuple[bytes, bytes]:
    """The bytes before and from an anchor on that strings of `length` bytes with it may hold."""
    return raw[max(0, at - (length - k)) : at], raw[at : at + length]


def digest(before: bytes, after: bytes) -> bytes:
    """128 bits of BLAKE2 over both sides and the place of the border between them: no two strings that anyone knows share them."""
    return hashlib.blake2b(len(before).to_bytes(2, "big") + before + after, digest_size=16).digest()


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text: doc is doc_id where those are unique, else a number in their order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    if seen.where("n > 1 OR doc_id IS NULL").limit(1).count() == 0:
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            places = pa.array(range(n, n + b.num_rows), pa.int64())
            n += b.num_rows
            yield pa.record_batch([pa.array([part] * b.num_rows, pa.int32()), places, *b.columns], names=["part", "place", "doc_id", "text"])

    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    placed = cut(ordered.mapInArrow(count, "part int, place long, doc_id long, text string"), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, "part").select((F.col("base") + F.col("place")).alias("doc"), "doc_id", "text")


def bucketed(docs: DataFrame) -> DataFrame:
    """The documents as a table bucketed by doc, with `copy`: whether an earlier document has the same text."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = numbered(docs)
    firsts = rows.groupBy(F.unhex(F.sha2("text", 256)).alias("mark")).agg(F.min("doc").alias("first"))
    firsts = firsts.select(F.col("first").alias("doc"), F.lit(False).alias("copy"))
    # the join deals texts out by doc, as the buckets want them; without the hint a small side might be broadcast, and each task write into all buckets
    rows = rows.join(firsts.hint("shuffle_hash"), "doc", "left").withColumn("copy", F.coalesce("copy", F.lit(True)))
    name = f"suffix_documents_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "doc").option("compression", "zstd").option("path", new_folder(spark, "suffix-documents")).saveAsTable(name)
    return spark.table(name)


def anchor_rows(table: DataFrame, digests: bool, length: int, k: int) -> DataFrame:
    """anchor, and with digests also doc, at and the digest of the surroundings, of the first copy of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, hashes, marks = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                at, h = anchors(raw, length, k)
                hashes.append(h)
                if digests:
                    places.append(at)
                    docs.append(np.full(len(at), doc, dtype=np.int64))
                    marks += [digest(*around(raw, i, length, k)) for i in at.tolist()]
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64))
            if digests:
                yield pa.record_batch([flat(hashes), flat(docs), flat(places), pa.array(marks, pa.binary())], names=["anchor", "doc", "at", "mark"])
            else:
                yield pa.record_batch([flat(hashes)], names=["anchor"])

    rows = table.where("NOT copy").select("doc", "text")
    return rows.mapInArrow(find, "anchor long, doc long, at long, mark binary" if digests else "anchor long")


def matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of bytes, padded with zeros to a multiple of 8."""
    wide = -(-width // 8) * 8
    return np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in parts), dtype=np.uint8).reshape(-1, wide)


def multikey_sort(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows of bytes within their groups: multikey quicksort whose keys are words of eight bytes.

    All rows are split by their first word; rows that are still equal are split by the next, until none is.
    """
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 0], group))
    same = (group[order][1:] == group[order][:-1]) & (words[order, 0][1:] == words[order, 0][:-1])
    for w in range(1, words.shape[1]):
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(tied):
            break
        run = np.cumsum(~np.concatenate([[False], same]))[tied]
        key = words[order[tied], w]
        order[tied] = order[tied][np.lexsort((key, run))]
        key = words[order[tied], w]
        still = np.zeros(len(order) - 1, dtype=bool)
        next_to = np.flatnonzero((tied[1:] == tied[:-1] + 1) & (run[1:] == run[:-1]) & (key[1:] == key[:-1]))
        still[tied[next_to]] = True
        same = still
    return order


def common_prefixes(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each sorted row, the bytes that it shares with the row before; -1 at the start of a group."""
    out = np.full(len(order), -1, dtype=np.int64)
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared = np.minimum(shared, np.minimum(sizes[a], sizes[b]))
    out[1:] = np.where(group[a] == group[b], shared, -1)
    return out


def earlier_strings(group: np.ndarray, before: list[bytes], after: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the strings that occur earlier reach before and after each anchor; 0, 0 where none does.

    Rows of a group share an anchor and come in order of position. A string starts d bytes before the anchor; two rows
    hold the same one if their last d bytes before it and their first length - d bytes from it on agree, which the
    shared prefixes of neighbours in the two sorted orders tell.
    """
    n = len(group)
    right, left = matrix(after, length), matrix([x[::-1] for x in before], length - k)
    r, l = np.array([len(x) for x in after]), np.array([len(x) for x in before])
    sides = []
    for rows, sizes in ((right, r), (left, l)):
        order = multikey_sort(rows, group)
        sides.append((order, common_prefixes(rows, sizes, group, order)))
    reach_left, reach_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def classes(side: int, depth: int) -> np.ndarray:
        order, shared = sides[side]
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(shared < depth)
        return out

    for d in range(length - k + 1):
        fit = np.flatnonzero((l >= d) & (r >= length - d))
        if len(fit) < 2:
            continue
        key = classes(0, length - d)[fit] * (n + 1) + classes(1, d)[fit]
        order = np.argsort(key, kind="stable")
        later = order[1:][key[order][1:] == key[order][:-1]]
        hit = fit[later]
        reach_left[hit] = np.maximum(reach_left[hit], d)
        reach_right[hit] = np.maximum(reach_right[hit], length - d)
    return reach_left, reach_right


def compare_bucket(length: int, k: int):
    """A function for mapInArrow over buckets sorted by anchor and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            lead = [x[3][:k] for x in rows]
            group = np.cumsum([i == 0 or lead[i] != lead[i - 1] for i in range(len(rows))])
            a, b = earlier_strings(group, [x[2] for x in rows], [x[3] for x in rows], length, k)
            keep = np.flatnonzero(b > 0)
            made = [pa.array([rows[i][c] for i in keep], pa.int64()) for c in (0, 1)]
            return pa.record_batch([*made, pa.array(a[keep]), pa.array(b[keep])], names=["doc", "at", "reach_left", "reach_right"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= BATCH:
                last, end = held[-1][3][:k], len(held)
                while end and held[end - 1][3][:k] == last:
                    end -= 1
                if end:
                    yield settle(held[:end])
                    held = held[end:]
        if held:
            yield settle(held)

    return run


def crowded(rows: DataFrame, length: int, k: int) -> DataFrame:
    """What compare_bucket finds, string by string: each is grouped by its bytes, with map-side minima."""
    strings = rows.withColumn("d", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(length) - F.length("after")), F.length("before"))))
    string = F.concat(F.expr("substring(before, length(before) - d + 1, d)"), F.expr(f"substring(after, 1, {length} - d)"))
    strings = strings.where((F.length("before") >= F.col("d")) & (F.length("after") >= length - F.col("d")))
    # the anchor stands at the same place of equal strings of the same d
    strings = strings.select("d", F.unhex(F.sha2(string, 256)).alias("string"), F.struct("doc", "at").alias("place"))
    firsts = strings.groupBy("d", "string").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = strings.join(firsts, ["d", "string"]).where("place <> first")
    return found.groupBy("place.doc", "place.at").agg(F.max("d").cast("long").alias("reach_left"), F.max(length - F.col("d")).cast("long").alias("reach_right"))


def removed_spans(table: DataFrame, length: int = LENGTH, k: int = ANCHOR, crowd: int | None = None) -> DataFrame:
    """doc, spans: the covered (first, end) around anchors, overlapping, of documents that are no exact copies.

    crowd is the number of suffixes of a bucket, if not given an even share of all for each shuffle partition, and TASK
    at least, which a task compares in bounded memory.
    """
    counted = anchor_rows(table, False, length, k).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    repeated = cut(counted, "anchors")
    if repeated.count() <= BROADCAST:
        repeated = F.broadcast(repeated)
    members = cut(anchor_rows(table, True, length, k).join(repeated, "anchor"), "members")
    firsts = members.groupBy("anchor", "mark").agg(F.min(F.struct("doc", "at")).alias("place"))
    firsts = cut(firsts.select("anchor", "mark", "place.doc", "place.at"), "firsts")
    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = firsts.join(several, "anchor").groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, some in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for x in some:
                    before, after = around(raw, x["at"], length, k)
                    out.append((doc, x["at"], before, after, x["n"]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            if out:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["doc", "at", "before", "after", "n"])

    # what is shuffled is the suffix and its place; its leading bytes are the anchor
    suffixes = table.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(fetch, "doc long, at long, before binary, after binary, n long")
    largest, total = (x or 0 for x in several.agg(F.max("n"), F.sum("n")).first())
    crowd = crowd or max(TASK, total // shuffle_partitions(table.sparkSession))
    few = suffixes.where(F.col("n") <= crowd) if largest > crowd else suffixes
    lead = F.substring(F.col("after"), F.lit(1), F.lit(k))
    buckets = few.drop("n").repartitionByRange(lead).sortWithinPartitions(lead, "doc", "at")
    reaches = buckets.mapInArrow(compare_bucket(length, k), "doc long, at long, reach_left long, reach_right long")
    if largest > crowd:
        reaches = reaches.unionByName(crowded(suffixes.where(F.col("n") > crowd), length, k))
    reaches = cut(reaches, "reaches")
    # surroundings that occur earlier are covered whole; (doc, at) is unique, so no surroundings, however frequent, meet in one task
    later = members.select("doc", "at").join(firsts.select("doc", "at"), ["doc", "at"], "left_anti")
    later = later.select("doc", (F.col("at") - (length - k)).alias("first"), (F.col("at") + length).alias("end"))
    early = reaches.select("doc", (F.col("at") - F.col("reach_left")).alias("first"), (F.col("at") + F.col("reach_right")).alias("end"))
    return later.union(early).groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, crowd: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining text (bytes that are no UTF-8 are replaced)."""
    table = bucketed(docs)
    spans = removed_spans(table, length, ANCHOR, crowd)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, copy, some in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                n = len(raw)
                if copy:
                    gone = [(0, n)] if n >= length else []
                else:
                    # the surroundings of an anchor near an end, or of one without an earlier string, may be short
                    gone = merged([(max(0, x["first"]), min(n, x["end"])) for x in some or [] if min(n, x["end"]) - max(0, x["first"]) >= length])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((key, n, n - len(left), len(gone), hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return table.join(spans, "doc", "left").select("doc_id", "text", "copy", "spans").mapInArrow(remove, RESULT)
