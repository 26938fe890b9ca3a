"""Saving batches against a plain loop that saves row by row, with windows that overflow; the store in any split, with replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import storing
from tidemill.operators.recent import recent_hits
from tidemill.session import new_path
from tidemill.streaming.saving import ARTICLES, ArticleStore, save_stream

MASK = (1 << 64) - 1
ROWS = "id long, url string, content_hash string, simhash long, t long"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def made(seed, n, first=1, zero=True):
    """Crowded prefixes, prefixes beside them, rows far from all, equal hashes, null times."""
    rng = random.Random(seed)
    crowd = [(0x7FFF << 48) | rng.getrandbits(48), (0x8000 << 48) | rng.getrandbits(48), rng.getrandbits(48), (0xFFFF << 48) | rng.getrandbits(48)]
    rows = []
    for i in range(first, first + n):
        kind = rng.random()
        h = rng.choice(crowd)
        if kind < 0.2:
            h = rng.getrandbits(64)
            crowd.append(h)
        elif kind < 0.25 and zero:
            h = 0
        else:
            for _ in range(rng.randint(0, 8)):
                h ^= 1 << rng.randrange(50)
            if kind > 0.9:
                h ^= 1 << 63  # the sign of the stored number
        rows.append((i, f"u{i if i % 23 else 23}", f"h{i if i % 19 else 19}", signed(h), None if rng.random() < 0.1 else rng.randrange(5000)))
    return rows


class Model:
    """The store as the sequential rule leaves it."""

    def __init__(self, window, most=10):
        self.window, self.most = window, most
        self.rows, self.cluster, self.confidence, self.hits = [], {}, {}, {}

    def save(self, batch):
        urls, digests, kept = set(), set(), []
        for r in batch:
            if r[1] not in urls and r[2] not in digests:
                urls.add(r[1])
                digests.add(r[2])
                kept.append(r)
        old = {x for r in self.rows for x in (r[1], r[2])}
        for r in [r for r in kept if r[1] not in old and r[2] not in old]:
            self.add(r)

    def add(self, r):
        i, _, _, h, t = r
        p = lambda x: (x & MASK) >> 48
        asked = [x for x in reversed(self.rows) if x[3]]
        seen = []
        if h:
            for q in (p(h), p(h) - 1, p(h) + 1):
                seen += [x for x in asked if p(x[3]) == q][: self.window - len(seen)]
            seen = seen or asked[: self.window]
        hits = []
        for x in seen:
            d = ((x[3] ^ h) & MASK).bit_count()
            if d <= self.most:
                hits.append((d, float("inf") if t is None or x[4] is None else abs(t - x[4]), -x[0]))
        self.rows.append(r)
        self.cluster[i], self.confidence[i] = i, 0.0
        if hits:
            d, _, best = min(hits)
            self.hits[i] = (d, -best)
            names = {self.cluster[-x[2]] for x in hits} | {i}
            self.cluster = {k: min(names) if c in names else c for k, c in self.cluster.items()}
            self.confidence[i] = 1 - d / 64
            self.confidence[-best] = max(self.confidence[-best], 1 - d / 64)


def frame(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    return df.withColumn("published", F.timestamp_seconds("t")).withColumn("collected", F.timestamp_seconds("id")).drop("t")


@pytest.fixture(params=[True, False])
def coalesced(spark, request):
    """With one partition for small tables, and with several that begin inside timelines."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(request.param).lower())
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("window", [1, 4, 500])
def test_window_of_recent_rows(spark, coalesced, window):
    rows = made(1, 220, zero=False)
    rows = [(i, f"u{i}", f"h{i}", h, t) for i, _, _, h, t in rows]
    model = Model(window)
    model.save(rows)
    old, new = rows[:70], rows[70:]
    got = recent_hits(frame(spark, new), frame(spark, old), collected="collected", window=window).collect()
    assert {r.id: (r.distance, r.best) for r in got} == {k: v for k, v in model.hits.items() if k > 70}
    assert all(len(r.others) == len(set(r.others)) <= window for r in got)


@pytest.mark.parametrize("window", [3, 500])
def test_saved_batches_against_a_loop(spark, window):
    rows = made(2, 160)
    model = Model(window)
    model.save(rows[:60])
    store = [(*r, model.cluster[r[0]]) for r in model.rows]
    stored = frame(spark, [r[:5] for r in store]).join(spark.createDataFrame([(r[0], r[5]) for r in store], "id long, cluster_id long"), "id")
    before, known = dict(model.cluster), dict(model.confidence)
    model.save(rows[60:])
    saved = storing.save_batch(frame(spark, rows[60:]), stored, collected="collected", window=window)
    got = {r.id: (r.cluster_id, r.duplication_confidence) for r in saved.rows.collect()}
    assert got == {i: (c, model.confidence[i]) for i, c in model.cluster.items() if i not in before}
    moved = {r.cluster_id: r.label for r in saved.moved.collect()}
    assert {i: moved.get(c, c) for i, c in before.items()} == {i: model.cluster[i] for i in before}
    raised = {r.id: r.duplication_confidence for r in saved.raised.collect()}
    assert {i: max(c, raised.get(i, 0.0)) for i, c in known.items()} == {i: model.confidence[i] for i in known}


def test_empty_batches_and_stores(spark):
    rows = frame(spark, made(3, 12))
    none = rows.limit(0).withColumn("cluster_id", F.col("id"))
    assert storing.save_batch(rows.limit(0), none).rows.count() == 0
    saved = storing.save_batch(rows, none)
    assert saved.rows.count() == 12 and saved.moved.count() == saved.raised.count() == 0


def now(store):
    return {r.id: (r.cluster_id, r.duplication_confidence) for r in store.read().collect()}


def test_store_in_any_split_and_with_replays(spark, tmp_path):
    rows = [r for r in made(4, 90) if r[0] % 23 and r[0] % 19]
    model = Model(5)
    model.save(rows)
    want = {i: (c, model.confidence[i]) for i, c in model.cluster.items()}
    for k, cuts in enumerate(([], [20, 21, 60])):
        store = ArticleStore(spark, str(tmp_path / f"store{k}")).create()
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        for n, part in enumerate(parts):
            store.save(frame(spark, part), n, window=5)
            before = now(store)
            store.save(frame(spark, part), n, window=5)  # the batch is run again
            store.save(frame(spark, rows), n, window=5)
            assert now(store) == before
        assert now(store) == want
        # a batch that failed before its commit leaves rows that no reader sees, and is written anew
        store._put(frame(spark, made(9, 5, first=1000)).withColumns({"cluster_id": F.col("id"), "duplication_confidence": F.lit(0.0)}), "articles", len(parts))
        assert now(store) == want


def test_store_fed_by_a_stream(spark, tmp_path):
    rows = [r for r in made(5, 60) if r[0] % 23 and r[0] % 19]
    model = Model(500)
    model.save(rows)
    source, place = new_path(spark, "articles"), new_path(spark, "articles-offsets")
    store = ArticleStore(spark, new_path(spark, "store")).create()
    fields = ", ".join(ARTICLES.split(", ")[:6])
    frame(spark, rows[:0]).write.parquet(source)
    for part in (rows[:25], rows[25:]):
        frame(spark, part).write.mode("append").parquet(source)
        save_stream(spark.readStream.schema(fields).parquet(source), store, place)
    assert now(store) == {i: (c, model.confidence[i]) for i, c in model.cluster.items()} and store.committed() == 1
