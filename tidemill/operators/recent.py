"""Near duplicates among the most recent rows before each row: the candidate window of saving one by one, as a merge.

Rows stand in one order: stored rows by the time they were collected, then the batch in its own order. A row is compared with the
`window` rows before it that share its 16-bit prefix, the most recent first; if those are fewer, with rows of the prefix below, then
of the prefix above, `window` in all; and if there is none, with the most recent `window` rows of any prefix.

A prefix is a timeline. Rows are range-partitioned by (timeline, order), whatever the size of a timeline, and every partition that
begins inside one is handed the last `window` entries before it. A task then reads its rows in order and holds the last `window`
entries only: no pair is made that is not compared, and a prefix with a third of all rows is dealt to many tasks.

Of all hits of a row, those that are joined by other hits already add nothing to clusters. A task keeps a label for
each entry that it holds and hands on one hit of each label, so a crowd of n copies gives about n links and not n times `window`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.dedup import written, written_counting

WINDOW, NEAR = 500, 10
ENTRY, QUERY = 1, 2
NEVER = (1 << 63) - 1
ALL = -2
ROW = ("timeline", "kind", "at", "id", "role", "simhash", "time")
SEEN = "id long, off int, seen int, hits array<struct<age:int,distance:int,apart:long,kind:long,tie:long,other:long>>"

Batches = Iterator[pa.RecordBatch]


def prefix(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 48).cast("int")


class Held:
    """The last entries of a timeline, oldest first, in arrays of twice the window."""

    FIELDS = ("simhash", "time", "id", "kind", "tie", "label")

    def __init__(self, window: int) -> None:
        self.window, self.n = window, 0
        self.of = {name: np.zeros(2 * window, np.int64) for name in self.FIELDS}

    def clear(self) -> None:
        self.n = 0

    def view(self, name: str) -> np.ndarray:
        return self.of[name][max(0, self.n - self.window) : self.n]

    def add(self, *values: int) -> None:
        if self.n == 2 * self.window:
            for a in self.of.values():
                a[: self.window] = a[self.window :]
            self.n = self.window
        for name, v in zip(self.FIELDS, values, strict=True):
            self.of[name][self.n] = v
        self.n += 1


def searching(window: int, most: int) -> Callable[[Batches], Batches]:
    """For each query: how many entries it sees, and its hits: the best and one of each label in its own timeline, all in others.

    off says which timeline: 0 its own, 1 the prefix below, 2 the one above. age counts entries back from the query. Of equal
    hits the greater (kind, tie) is better: rows of the batch before stored ones, later ones first, of stored ones the greater id.
    """
    hit = pa.struct([("age", pa.int32()), ("distance", pa.int32()), ("apart", pa.int64()), ("kind", pa.int64()), ("tie", pa.int64()), ("other", pa.int64())])

    def told(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(hit))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["id", "off", "seen", "hits"])

    def run(batches: Batches) -> Batches:
        held, now, label = Held(window), None, 0
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("part", "timeline", "kind", "at", "id", "role", "own", "one", "simhash", "time")]
            for part, timeline, kind, at, id_, role, own, one, hash_, time in zip(*columns, strict=True):
                if (part, timeline) != now:
                    now = (part, timeline)
                    held.clear()
                label += 1
                if role & QUERY:
                    # of signed numbers, numpy counts the bits of the absolute value
                    distance = np.bitwise_count((held.view("simhash") ^ np.int64(hash_)).view(np.uint64)).astype(np.int64)
                    near = np.flatnonzero(distance <= most)
                    hits = []
                    if len(near):
                        d, times, other, kinds, ties, labels = distance[near], *(held.view(c)[near] for c in ("time", "id", "kind", "tie", "label"))
                        apart = np.full(len(near), NEVER) if time is None else np.where(times == NEVER, NEVER, np.abs(times - time))
                        order = np.lexsort((-ties, -kinds, apart, d))
                        if own and one:
                            _, first = np.unique(labels[order], return_index=True)
                            order = order[sorted({0, *first.tolist()})]
                            held.view("label")[np.isin(held.view("label"), labels)] = label
                        age = len(distance) - 1 - near
                        rows = zip(*(x[order].tolist() for x in (age, d, apart, kinds, ties, other)), strict=True)
                        hits = [dict(zip(("age", "distance", "apart", "kind", "tie", "other"), x, strict=True)) for x in rows]
                    off = 0 if own else 1 if timeline < (hash_ >> 48 & 0xFFFF) else 2
                    found.append((id_, off, len(distance), hits))
                if role & ENTRY:
                    held.add(hash_, NEVER if time is None else time, id_, kind, at if kind else id_, label)
            if found:
                yield told(found)

    return run


def searched(rows: DataFrame, window: int, most: int) -> DataFrame:
    """SEEN for each query of rows (ROW, own, and one: whether hits are thinned out): the merge over range partitions with the last entries before each of them."""
    order = ["timeline", "kind", "at", "id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "timelines")
    entry = F.col("role").bitwiseAND(F.lit(ENTRY)) != 0
    # entries of a timeline before each partition: rows are few, one for each partition and timeline
    counts = dealt.groupBy("timeline", "part").agg(F.count_if(entry).alias("n"))
    earlier = Window.partitionBy("timeline").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    going_on = counts.where("base > 0").select("timeline", F.col("part").alias("to"), F.col("base").alias("end"), F.floor(F.greatest(F.col("base") - window, F.lit(0)) / window).alias("low"), F.floor((F.col("base") - 1) / window).alias("high"))
    wanted = going_on.select("timeline", "to", "end", F.explode(F.sequence("low", "high")).alias("block"))
    inside = Window.partitionBy("part", "timeline").orderBy("kind", "at", "id")
    # ranks matter only in timelines that go on
    open_ = dealt.where(entry).join(going_on.select("timeline").distinct(), "timeline", "left_semi").join(counts.select("timeline", "part", "base"), ["timeline", "part"])
    ranked = open_.withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).withColumn("block", F.floor(F.col("rank") / window))
    lent = ranked.join(wanted, ["timeline", "block"]).where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - window))
    lent = lent.withColumn("role", F.lit(ENTRY)).withColumn("part", F.col("to")).select(*dealt.columns)
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    every = dealt.unionByName(lent).repartition(int(n), "part").sortWithinPartitions("part", *order)
    return every.select(*ROW, "part", "own", "one").mapInArrow(searching(window, most), SEEN)


def gathered(
    batch: DataFrame, stored: DataFrame, order: str = "id", time: str = "published", collected: str | None = None, window: int = WINDOW, most: int = NEAR, among: bool = True
) -> DataFrame:
    """id and hits of each row of the batch: the candidates of its window within `most` bits.

    batch and stored have id, simhash and `time` (a timestamp, may be null); stored rows stand in the order of `collected` (`time`
    if not given), nulls first, then of their ids. With `among`, rows of the batch are candidates of those after them, and of
    hits that others join already one stays; without, all hits are stored rows and all are given.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp")).alias("time")
    since = F.unix_micros(F.col(collected or time).cast("timestamp"))
    fresh = batch.where("simhash <> 0").select(F.lit(1).alias("kind"), F.col(order).cast("long").alias("at"), "id", "simhash", micros)
    old = stored.where("simhash <> 0").select(F.lit(0).alias("kind"), F.coalesce(since, F.lit(-NEVER)).alias("at"), "id", "simhash", micros)
    asking = ENTRY | QUERY if among else QUERY
    p = prefix(F.col("simhash"))
    # a stored row that has `window` later ones in its prefix is never seen; nor is one whose prefix no row of the batch comes near
    newest = Window.partitionBy("timeline").orderBy(F.desc("at"), F.desc("id"))
    asked = F.filter(F.array(p, p - 1, p + 1), lambda q: (q >= 0) & (q <= 0xFFFF))
    lines = fresh.select(F.explode(asked).alias("timeline")).distinct()
    known = old.withColumn("timeline", p).join(lines, "timeline", "left_semi").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= window).drop("k")
    entries = known.withColumn("role", F.lit(ENTRY)).withColumn("own", F.lit(False)).withColumn("one", F.lit(among))
    queries = fresh.withColumn("own_line", p).withColumn("timeline", F.explode(asked)).withColumn("own", F.col("timeline") == F.col("own_line")).drop("own_line")
    queries = queries.withColumn("role", F.when(F.col("own"), asking).otherwise(QUERY)).withColumn("one", F.lit(among))
    seen = searched(entries.unionByName(queries), window, most)
    of = lambda k, c: F.when(F.col("off") == k, F.col(c))
    sides = [x for k in range(3) for x in (F.coalesce(F.max(of(k, "seen")), F.lit(0)).alias(f"n{k}"), F.flatten(F.collect_list(of(k, "hits"))).alias(f"h{k}"))]
    both = seen.groupBy("id").agg(*sides)
    # the prefix below is looked at for what the own one leaves, the one above for what both leave
    below = F.greatest(F.lit(window) - F.col("n0"), F.lit(0))
    above = F.greatest(below - F.col("n1"), F.lit(0))
    hits = F.concat("h0", F.filter("h1", lambda h: h["age"] < below), F.filter("h2", lambda h: h["age"] < above))
    both, n_lone = written_counting(both.select("id", hits.alias("hits"), ((F.col("n0") + F.col("n1") + F.col("n2")) == 0).alias("lone")), "hits", F.col("lone"))
    near = both.where(F.size("hits") > 0).select("id", "hits")
    # rows that saw nothing look at the most recent rows of all
    if n_lone:
        lone = both.where("lone").select("id", F.lit(True).alias("asks"))
        last = old.orderBy(F.desc("at"), F.desc("id")).limit(window).withColumn("role", F.lit(ENTRY))
        asks = fresh.join(lone, "id", "left").withColumn("role", F.when(F.col("asks"), asking).otherwise(ENTRY if among else 0)).drop("asks").where("role > 0")
        line = last.unionByName(asks).withColumns({"timeline": F.lit(ALL), "own": F.lit(True), "one": F.lit(among)})
        near = near.unionByName(searched(line, window, most).where(F.size("hits") > 0).select("id", "hits"))
    return near


def recent_hits(batch: DataFrame, stored: DataFrame, order: str = "id", time: str = "published", collected: str | None = None, window: int = WINDOW, most: int = NEAR) -> DataFrame:
    """id, distance, best and others of each row of the batch that has a hit: the best one, its distance, and ids enough to
    tell which clusters all hits have. Rows without words (SimHash 0) neither ask nor answer."""
    near = gathered(batch, stored, order, time, collected, window, most)
    best = F.array_min(F.transform("hits", lambda h: F.struct(h["distance"].alias("distance"), h["apart"].alias("apart"), (-h["kind"]).alias("kind"), (-h["tie"]).alias("tie"), h["other"].alias("other"))))
    return near.select("id", best["distance"].alias("distance"), best["other"].alias("best"), F.transform("hits", lambda h: h["other"]).alias("others"))
