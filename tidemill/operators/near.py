"""Near SimHashes without their pairs: links that join what is near, the best match of each row, and what leads.

Rows whose 16-bit prefixes are equal or neighbours are compared. A prefix with many rows is cut into blocks of bounded size, and
each two blocks that may hold pairs meet in one group: no task gets more than two blocks at a time, and only links, best
matches, ids or nearest leaders leave it. All pairs of a crowd are still looked at where none can be spared, as bits in arrays, but never written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.dedup import NEAR

BLOCK, CELLS = 8192, 1 << 20
KEY = ("line", "beside", "a", "b")
NEVER = (1 << 63) - 1
Batches = Iterator[pa.RecordBatch]


def met(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """rows (id, simhash and more) with KEY and side, once for each group that they are in, dealt out and sorted by group.

    A group is a block of a prefix alone, two blocks of it, or (beside) one of it and one of the next prefix.
    """
    given = rows.withColumn("prefix", F.shiftrightunsigned("simhash", 48).cast("int"))
    blocks = given.groupBy("prefix").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    other = lambda step, name: blocks.select((F.col("prefix") - step).alias("prefix"), F.col("n").alias(name))
    known = blocks.join(other(1, "above"), "prefix", "left").join(other(-1, "below"), "prefix", "left")  # 65,536 rows at most
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda line, beside, a, b, side: F.struct(line.alias("line"), F.lit(beside).alias("beside"), a.alias("a"), b.alias("b"), side.alias("side"))
    p, k, zero, one = F.col("prefix"), F.col("k"), F.lit(0), F.lit(1)
    groups = F.concat(
        F.transform(upto(F.col("n")), lambda j: group(p, False, F.least(k, j), F.greatest(k, j), (k > j).cast("int"))),
        F.transform(upto(F.coalesce("above", zero)), lambda j: group(p, True, k, j, zero)),
        F.transform(upto(F.coalesce("below", zero)), lambda j: group(p - 1, True, j, k, one)),
    )
    dealt = given.join(known, "prefix").withColumn("k", own).select(*rows.columns, F.explode(groups).alias("g")).select("g.*", *rows.columns)
    return dealt.repartition(*KEY).sortWithinPartitions(*KEY, "side", "id")


def groups_of(batches: Batches, names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of each group, of batches that are sorted by group; a group may go on in the next batch."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, *names)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        bounds = np.flatnonzero(np.any([c[1:] != c[:-1] for c in now[: len(KEY)]], axis=0)) + 1
        starts = [0, *bounds.tolist()]
        for lo, hi in zip(starts, starts[1:]):
            yield [c[lo:hi] for c in now[len(KEY) :]]
        held = [c[starts[-1] :] for c in now]
    if held is not None and len(held[0]):
        yield held[len(KEY) :]


def facing(batches: Batches, names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The columns of rows and of those that they are compared with, by id: a block alone with itself, one of two blocks with the other."""
    for sides, *columns in groups_of(batches, ("side", *names)):
        n = int(np.searchsorted(sides, 1))
        one, two = [c[:n] for c in columns], [c[n:] for c in columns]
        yield from ((one, one),) if n == len(sides) else ((one, two), (two, one)) if n else ()


def packed(found: Iterator[tuple[np.ndarray, ...]], names: list[str], size: int = BLOCK) -> Batches:
    """What many groups found, in batches of about `size` rows."""
    held, n = [], 0
    for some in found:
        held.append(some)
        n += len(some[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of signed numbers, numpy counts the bits of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def linking(most: int) -> Callable[[Batches], Batches]:
    """For each group, the least id of each of its components with every other id of it."""

    def run(batches: Batches) -> Batches:
        for ids, hashes in groups_of(batches, ("id", "simhash")):
            open_, links = np.arange(len(ids)), []
            while len(open_) > 1:
                root, open_, i = [int(open_[0])], open_[1:], 0
                while i < len(root) and len(open_):
                    near = distances(hashes[open_], hashes[root[i]]) <= most
                    root.extend(open_[near].tolist())
                    open_, i = open_[~near], i + 1
                if len(root) > 1:
                    members = np.sort(ids[root])
                    links.append((np.full(len(members) - 1, members[0]), members[1:]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*links, strict=True)], names=["id", "other"])

    return run


def near_links(rows: DataFrame, most: int = NEAR, size: int = BLOCK) -> DataFrame:
    """id and other of rows (id, simhash): fewer links than rows in each group, with the components that all near pairs have.

    A row that has been reached is not compared again, so a crowd costs what its rows and its strangers cost.
    """
    return met(rows.select("id", "simhash"), size).select(*KEY, "id", "simhash").mapInArrow(linking(most), "id long, other long").distinct()


def matching(most: int) -> Callable[[Batches], Batches]:
    """For each group, the best earlier match in it of each row."""

    def best(ids, hashes, times, with_ids, with_hashes, with_times) -> tuple[np.ndarray, ...]:
        found = []
        step = max(1, CELLS // max(1, len(with_ids)))
        for lo in range(0, len(ids), step):
            at = slice(lo, lo + step)
            d = np.where(with_ids < ids[at, None], distances(with_hashes, hashes[at, None]), most + 1)
            least = d.min(axis=1, initial=most + 1)
            rows = np.flatnonzero(least <= most)
            same = d[rows] == least[rows, None]
            mine = times[at][rows, None]
            apart = np.where(same, np.where((with_times == NEVER) | (mine == NEVER), NEVER, np.abs(with_times - mine)), NEVER)
            nearest = apart.min(axis=1, initial=NEVER)
            match = np.where(same & (apart == nearest[:, None]), with_ids, -NEVER).max(axis=1, initial=-NEVER)
            found.append((ids[at][rows], least[rows].astype(np.int32), nearest, match))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Batches) -> Batches:
        for of, among in facing(batches, ("id", "simhash", "time")):
            made = best(*of, *among)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["id", "distance", "apart", "match"])

    return run


def best_earlier(rows: DataFrame, time: str, most: int = NEAR, size: int = BLOCK) -> DataFrame:
    """id, match, distance: the best earlier match of each row of (id, simhash, time) that has one within `most` bits: least distance,
    then least time apart (unknown last), then the newest id. Each group tells one match for a row, so no pairs are shuffled."""
    given = rows.where("simhash <> 0").select("id", "simhash", F.coalesce(F.unix_micros(time), F.lit(NEVER)).alias("time"))
    # two blocks of a prefix and a block alone differ: what a block holds itself is compared there
    groups = met(given, size).select(*KEY, "side", "id", "simhash", "time")
    found = groups.mapInArrow(matching(most), "id long, distance int, apart long, match long")
    best = found.groupBy("id").agg(F.min(F.struct("distance", "apart", (-F.col("match")).alias("newest"))).alias("best"))
    return best.select("id", (-F.col("best.newest")).alias("match"), F.col("best.distance").alias("distance"))


def following(most: int) -> Callable[[Batches], Batches]:
    """For each group, the asking rows with an earlier telling row near them in it. What has one is not compared again."""

    def found(batches: Batches) -> Iterator[tuple[np.ndarray, ...]]:
        for (ids, hashes, asks, _), (with_ids, with_hashes, _, tells) in facing(batches, ("id", "simhash", "asks", "tells")):
            open_, with_ids, with_hashes, lo = np.flatnonzero(asks), with_ids[tells], with_hashes[tells], 0
            while len(open_) and lo < len(with_ids):
                at = slice(lo, lo := lo + max(1, CELLS // len(open_)))
                near = (distances(hashes[open_, None], with_hashes[at]) <= most) & (with_ids[at] < ids[open_, None])
                seen = near.any(axis=1)
                yield (ids[open_[seen]],)
                open_ = open_[~seen]

    return lambda batches: packed(found(batches), ["id"])


def followers(rows: DataFrame, asks: Column, tells: Column, most: int = NEAR, size: int = BLOCK) -> DataFrame:
    """The ids of asking rows of (id, simhash) that have an earlier telling one within `most` bits."""
    given = rows.select("id", "simhash", asks.alias("asks"), tells.alias("tells"))
    return met(given, size).select(*KEY, "side", "id", "simhash", "asks", "tells").mapInArrow(following(most), "id long").distinct()


def naming(most: int) -> Callable[[Batches], Batches]:
    """For each class and group, the leaders in it that are nearest to a row of the class: each nearer than all before it."""

    def found(batches: Batches) -> Iterator[tuple[np.ndarray, ...]]:
        for (ids, last, hashes, _), (with_ids, _, with_hashes, leads) in facing(batches, ("id", "last", "simhash", "leads")):
            with_ids, with_hashes = with_ids[leads], with_hashes[leads]
            step = max(1, CELLS // max(1, len(with_ids)))
            for lo in range(0, len(ids) if len(with_ids) else 0, step):
                at = slice(lo, lo + step)
                d = np.where(with_ids <= last[at, None], distances(hashes[at, None], with_hashes), np.uint8(most + 1))
                rows = np.flatnonzero(d.min(axis=1) <= most)
                d = d[rows]
                nearer = d <= most
                nearer[:, 1:] &= d[:, 1:] < np.minimum.accumulate(d, axis=1)[:, :-1]
                i, k = np.nonzero(nearer)
                # of the leaders before the whole class, the last of them is the nearest
                kept = np.ones(len(i), bool)
                kept[:-1] = (i[1:] != i[:-1]) | (with_ids[k[1:]] > ids[at][rows[i[1:]]])
                i, k = i[kept], k[kept]
                yield hashes[at][rows[i]], with_ids[k], d[i, k].astype(np.int32)

    return lambda batches: packed(found(batches), ["simhash", "leader", "distance"])


def near_leaders(classes: DataFrame, most: int = NEAR, size: int = BLOCK) -> DataFrame:
    """simhash, leader, distance of classes (id, last, simhash, leads): for each row of a class, from id to last, the nearest leader
    that is not after it is among them. A group names `most` + 1 leaders for a class at most, one where the class is one row."""
    groups = met(classes.select("id", "last", "simhash", "leads"), size).select(*KEY, "side", "id", "last", "simhash", "leads")
    return groups.mapInArrow(naming(most), "simhash long, leader long, distance int")
