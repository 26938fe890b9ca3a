"""Divergence of sources within a language (operator 13): dense term-block matrices of exact 64-bit shares.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms in at
least `least` of its documents. For every group (lang, source), and for the language as a whole, a kept term has the share
p = 1 + floor(10**9 * (count + 1) / (N + V)). Two groups differ by the sum over kept terms of floor((p - q)**2 / q),
and a group's own terms are those whose share exceeds the language's, largest floor((p - q)**2 / q) first.

How: tasks count terms of each group in bounded tables, and the counts are shuffled by term. The kept terms of a language
are dealt out, by a hash, into blocks of about BLOCK cells: terms times groups. A block becomes a dense int64 tile of
groups by terms in which absent terms count 0, and the differences of all pairs of groups are taken by broadcasting, a
bounded slab at a time. A task adds up the pair matrices of its blocks and merges one list of best terms a group; sums and
lists of all tasks meet in Spark, the lists in two steps, so that no group gathers those of all tasks at once.

Scale: texts are never shuffled. Languages, sources and terms may be hot: rows are summed in tasks before they are
shuffled, and a language is spread over its blocks. Where a language has so many groups that its matrix exceeds SLAB
numbers, each block is dealt to several tasks, each with some rows of the matrix. One row a language lists its groups; it
is joined to blocks, not broadcast by force. The result has all ordered pairs of sources of a language, as asked.

Defined results: null text, lang and source are empty strings; every row is a document, repeated ones too; a language
without kept terms has pairs of value 0; a lone source has no pairs; ties of value go by the item's bytes; other columns are left
out; an empty table gives no row. Shares are exact up to 9 * 10**15 occurrences of a language's terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, shuffle_partitions

LEAST, TOP, UNIT = 3, 200, 10**9
#: Cells of a tile, numbers of a slab of differences or of a task's matrix, and entries of a task's table of counts.
BLOCK, SLAB, TABLE = 1 << 16, 1 << 21, 400_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Bytes to those of a term, lower-cased, or to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Batches = Iterator[pa.RecordBatch]
COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, those of about `piece` bytes at a time."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counting(limit: int = TABLE) -> Callable[[Batches], Batches]:
    """Occurrences of each term, and documents with it, by group; a table that is full is handed on and begun anew."""

    def handed(table: dict[tuple[str, str], tuple[Counter, Counter]]) -> Batches:
        for (lang, source), (n, docs) in table.items():
            if n:
                found = list(n)
                names = [pa.array([x] * len(found)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays(
                    [*names, pa.array(found, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in found], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Batches) -> Batches:
        table: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                n, docs = table.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                own: set[bytes] = set()
                for found in terms(text.as_py()):
                    n.update(found)
                    own.update(found)
                docs.update(own)
                held += len(n)
                if held >= limit:
                    yield from handed(table)
                    table, held = {}, 0
        yield from handed(table)

    return run


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, sources and counts of each kept term; one shuffle, of the tasks' sums."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(counting(), COUNTS).repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list("source").alias("sources"), F.collect_list("n").alias("counts"))
    return by_term.where(F.col("docs") >= least).drop("docs")


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each language: its sources in order, the occurrences of kept terms in each, and the number of kept terms."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    known = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    return known.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("groups"), F.col("g.n").alias("totals"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), three digits at a time, so that no product leaves 64 bits."""
    quotient, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digits
    return quotient + 1


def tile_of(groups: list[str], entries: list[dict[str, Any]]) -> np.ndarray:
    """Counts of a block: groups by terms."""
    place = {g: i for i, g in enumerate(groups)}
    tile = np.zeros((len(groups), len(entries)), np.int64)
    for j, e in enumerate(entries):
        tile[[place[s] for s in e["sources"]], j] = e["counts"]
    return tile


def pair_sums(p: np.ndarray, rows: slice, slab: int = SLAB) -> np.ndarray:
    """Of each group of rows with each group: the sum of floor((p - q)**2 / q), all pairs of a slab of terms broadcast at once."""
    own = p[rows]
    total = np.zeros((len(own), len(p)), np.int64)
    width = max(1, slab // max(1, total.size))
    for at in range(0, p.shape[1], width):
        q = p[:, at : at + width]
        d = own[:, None, at : at + width] - q[None]
        total += (d * d // q[None]).sum(2)
    return total


def best_terms(names: list[str], counts: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> list[tuple[int, str]]:
    """The group's terms above the language's share, as sorted (-value, term), at most the first top."""
    at = np.flatnonzero((counts > 0) & (p > q))
    value = (p[at] - q[at]) ** 2 // q[at]
    if len(at) > top:  # all that tie with the last stay until they are ordered by name
        enough = value >= np.partition(value, len(value) - top)[len(value) - top]
        at, value = at[enough], value[enough]
    return sorted((-v, names[j]) for v, j in zip(value.tolist(), at.tolist(), strict=True))[:top]


def comparing(top: int = TOP) -> Callable[[Batches], Batches]:
    """Sums of pairs and best terms of the blocks of a task; those of one (lang, part) follow each other."""
    columns = ["lang", "source", "part", "item", "value"]

    def told(lang: str, groups: list[str], first: int, total: np.ndarray, lists: dict[int, list[tuple[int, str]]]) -> Batches:
        for i, sums in enumerate(total.tolist(), first):
            others = [j for j in range(len(groups)) if j != i]
            found = [("pair", groups[j], sums[j]) for j in others] + [("term", t, -v) for v, t in lists.get(i, [])]
            if found:
                part, item, value = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([groups[i]] * len(found)), pa.array(part), pa.array(item), pa.array(value, pa.int64())], names=columns)

    def run(batches: Batches) -> Batches:
        now: tuple | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                groups, rows = r["groups"], slice(r["first"], min(r["first"] + r["width"], len(r["groups"])))
                if now is None or now[:1] + now[2:3] != (r["lang"], rows.start):
                    if now is not None:
                        yield from told(*now)
                    now = (r["lang"], groups, rows.start, np.zeros((rows.stop - rows.start, len(groups)), np.int64), {})
                names = [e["term"] for e in r["entries"]]
                counts = tile_of(groups, r["entries"])
                totals = np.array(r["totals"], np.int64)
                p = shares(counts, (totals + r["n_terms"])[:, None])
                q = shares(counts.sum(0), totals.sum() + r["n_terms"])
                now[3][:] += pair_sums(p, rows)
                for g in range(rows.start, rows.stop):
                    now[4][g] = list(islice(merge(now[4].get(g, []), best_terms(names, counts[g], p[g], q, top)), top))
        if now is not None:
            yield from told(*now)

    return run


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to every other source of the language (`pair`),
    and its `top` own terms (`term`)."""
    n = shuffle_partitions(docs.sparkSession)
    kept = cut(kept_counts(docs, least), "terms")
    langs = cut(languages(docs, kept), "langs")
    size = F.size("groups")
    wide = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / size)).cast("int")
    plan = langs.select("lang", F.ceil(F.col("n_terms") / wide).cast("int").alias("n_blocks")).where(F.col("n_blocks") > 0)
    entries = kept.join(plan, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int"))
    blocks = entries.groupBy("lang", "block").agg(F.collect_list(F.struct("term", "sources", "counts")).alias("entries"))
    width = F.least(size, F.greatest(F.lit(1), F.floor(F.lit(SLAB) / size))).cast("int")
    parts = blocks.join(langs, "lang").withColumn("width", width).withColumn("first", F.explode(F.sequence(F.lit(0), size - 1, F.col("width"))))
    dealt = parts.repartition(n, "lang", "block", "first").sortWithinPartitions("lang", "first")
    found = dealt.drop("block").mapInArrow(comparing(top), "lang string, source string, part string, item string, value long")
    found = cut(found.withColumn("task", F.spark_partition_id()), "divergence")
    pairs = found.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = langs.where(F.col("n_terms") == 0)
    zero = bare.select("lang", F.explode("groups").alias("source"), "groups").select("lang", "source", F.lit("pair").alias("part"), F.explode("groups").alias("item"), F.lit(0).cast("long").alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    ranked = Window.partitionBy("lang", "source", "part")
    some = max(1, round(n**0.5))
    few = found.where(F.col("part") == "term").withColumn("some", F.pmod(F.col("task"), F.lit(some)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part", "some").orderBy(*order))).where(F.col("rank") <= top)
    own = few.select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(ranked.orderBy(*order))).where(F.col("rank") <= top)
    far = pairs.unionByName(zero.where(F.col("source") != F.col("item"))).withColumn("rank", F.row_number().over(ranked.orderBy(*order)))
    return far.unionByName(own)
