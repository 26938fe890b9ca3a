"""Near SimHashes in blocks against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import dedup, explain, near, storing


def crowd(seed: int) -> list[tuple]:
    """Hashes of three neighbouring prefixes, some near and some copies, with times of which some are unknown."""
    rng = random.Random(seed)
    starts = [rng.getrandbits(48) for _ in range(6)]
    rows = []
    for k in range(240):
        low = rng.choice(starts)
        for _ in range(rng.choice([0, 1, 3, 8, 30])):
            low ^= 1 << rng.randrange(48)
        whole = rng.choice([0x7FFE, 0x7FFF, 0x8000]) << 48 | low
        rows.append((k * 7 % 241, whole - (1 << 64) if whole >> 63 else whole, None if k % 11 == 0 else rng.randrange(40)))
    return rows


@pytest.mark.parametrize("size", [7, 64, 8192])
def test_blocks_tell_what_all_pairs_tell(spark, size):
    rows = spark.createDataFrame(crowd(size), "id long, simhash long, t long").withColumn("t", F.timestamp_seconds("t")).cache()
    pairs = dedup.near_pairs(rows, "id")
    want = {tuple(r) for r in explain.best_matches(pairs, rows, "id", "t").select("id", "match", "distance").collect()}
    assert {tuple(r) for r in near.best_earlier(rows, "t", size=size).select("id", "match", "distance").collect()} == want
    found = near.near_links(rows, size=size)
    assert {tuple(r) for r in dedup.clusters(rows, found).collect()} == {tuple(r) for r in dedup.clusters(rows, pairs).collect()}


def test_a_crowd_has_fewer_links_than_rows(spark):
    rows = spark.range(3000).select("id", (F.lit(1 << 50) + F.col("id") % 1024).alias("simhash"))
    assert near.near_links(rows).count() == 2999


@pytest.mark.parametrize("size", [7, 64, 8192])
def test_leaders_in_blocks_against_a_loop(spark, size):
    """Neighbouring prefixes, rows that wait for rows that wait, and copies that follow a leader after the first of their class."""
    rows = [(k, h) for k, h, _ in crowd(size + 1)]
    rows += [(300 + k, rows[k * 7 % 200][1]) for k in range(60)]
    led, want = [], {}
    for i, h in sorted(rows):
        low = lambda x: x % (1 << 64)
        close = [(d, k) for k, g in led if abs((low(h) >> 48) - (low(g) >> 48)) <= 1 and (d := low(h ^ g).bit_count()) <= 10]
        want[i] = min(close)[1] if close else i
        if not close:
            led.append((i, h))
    assert len(led) > 9 and any(v > i - 300 for i, v in want.items() if i >= 300)
    got = storing.leader_clusters(spark.createDataFrame(rows, "id long, simhash long"), size=size)
    assert {r.id: r.leader for r in got.collect()} == want


def test_leaders_write_rows_and_not_pairs(spark, monkeypatch):
    """In a crowd whose rows are all near each other, what is written grows with the rows."""
    rows = spark.range(2000).select("id", (F.lit(1 << 50) + F.shiftleft(F.col("id"), 3) % 1024 + F.shiftright(F.col("id"), 7)).alias("simhash")).dropDuplicates(["simhash"]).cache()
    n, kept = rows.count(), []

    def counting(df, name, make=dedup.written):
        kept.append(made := make(df, name))
        return made

    for module in (dedup, storing):
        monkeypatch.setattr(module, "written", counting)
    assert storing.leader_clusters(rows).where("leader IS NULL").count() == 0
    assert n > 1000 and sum(x.count() for x in kept) < 12 * n
