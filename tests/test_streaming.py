"""Streams against their batch forms: replays in any number of steps, restarts, timers and late events."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import folds, monitoring
from tidemill.plans.registry import queries
from tidemill.session import new_path
from tidemill.streaming import events as streams
from tidemill.streaming import sources_state as states

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
RUN = "spark.sql.shuffle.partitions"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get(RUN)
    spark.conf.set(RUN, 2)
    yield
    spark.conf.set(RUN, before)


def made(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(minutes=m), u, k, float(i), f"p{i}") for i, (m, u, k) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(3)
    kinds = ["click", "purchase", "error", "error", "error", "view"]
    return made(spark, [(20 * i, rng.randrange(5), rng.choice(kinds)) for i in range(300)])


def test_windows_in_any_number_of_steps(spark, some):
    want = sorted(tuple(r) for r in some.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").count().collect())
    for steps in (1, 3):
        rows, late = streams.replayed(some, streams.tumbling, "complete", "w", steps=steps)
        assert sorted((r.day, r.event_type, r.n) for r in rows.collect()) == want and late == 0


def test_each_event_comes_once(spark, some):
    rows, late = streams.replayed(some.unionAll(some), streams.fresh, "append", "f", steps=3)
    assert sorted(r.event_id for r in rows.collect()) == list(range(300)) and late == 0
    none, late = streams.replayed(some.limit(0), streams.fresh, "append", "f")
    assert none.count() == 0 and late == 0


def test_late_events_are_counted(spark, some):
    source, path, place = (new_path(spark, x) for x in ("late-source", "late", "late-offsets"))
    some.where("event_id >= 150").write.parquet(source)
    stream = streams.fresh(streams.read_events(spark, source, None))
    assert streams.advance(stream, "append", path, place) == 0
    some.where("event_id < 10").write.mode("append").parquet(source)
    assert streams.advance(stream, "append", path, place) == 10


def test_fold_equals_the_batch_form(spark, some):
    batch = {r.user_id: r for r in folds.fold_events(some.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    rows, _ = streams.replayed(some, states.fold_stream, "update", "fold", steps=3)
    fields = [c for c in rows.columns if c not in ("user_id", "batch")]
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("user_id", "s.*").collect()
    assert {r.user_id: r.asDict() for r in last} == {k: r.asDict() for k, r in batch.items()}


def newest(rows):
    last = F.max_by(F.struct("in_a_row", "state", "retry_ms", "last_error", "due"), F.struct("batch", F.col("cause") != "events")).alias("s")
    return {r.user_id: r for r in rows.groupBy("user_id").agg(last).select("user_id", "s.*").collect()}


def test_circuits_equal_the_batch_form_after_restarts(spark, some):
    """Each step of a replay starts the query anew from its checkpoint."""
    rows, late = streams.replayed(some, states.circuit_stream, "update", "circuit", steps=4)
    kind, props = F.col("event_type"), F.concat(F.lit("failed with "), F.col("props"))
    batch = monitoring.circuit_states(some.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", ["ts", "event_id"], kind == "error", kind == "purchase", props)
    batch = batch.withColumn("retry_ms", F.unix_millis("retry_at"))
    got = newest(rows)
    want = {r.user_id: r for r in batch.collect()}
    assert got.keys() == want.keys() and late == 0
    for k, r in want.items():
        assert (got[k].in_a_row, got[k].state, got[k].retry_ms, got[k].last_error) == (r.in_a_row, r.state, r.retry_ms, r.last_error)


def test_timers_end_cooldowns_and_forget(spark):
    source, path, place = (new_path(spark, x) for x in ("timer-source", "timer", "timer-offsets"))
    hour = 60
    parts = [
        [(0, 1, "error"), (1, 1, "error"), (2, 1, "error"), (3, 2, "error"), (4, 3, "error"), (5, 3, "error"), (6, 3, "error")],
        [(2 * hour, 3, "purchase"), (2 * hour, 9, "view")],
        [(7 * hour, 9, "view")],  # the watermark passes the fourth hour: 1 is due without an event of its own, 3 was closed before
        [(100 * hour, 9, "view")],  # 1, 2 and 3 have been idle for three days
    ]
    made(spark, []).write.parquet(source)
    stream = states.circuit_stream(streams.read_events(spark, source, None), forget_ms=72 * 3600 * 1000)
    seen = []
    for rows in parts:
        made(spark, rows).write.mode("append").parquet(source)
        streams.advance(stream, "update", path, place)
        found = spark.read.option("recursiveFileLookup", "true").schema(states.CIRCUIT_ROWS + ", batch int").parquet(path)
        seen.append({(r.user_id, r.state, r.due, r.cause) for r in found.collect()})
    assert {(1, "COOLDOWN", False, "events"), (2, "ACTIVE", False, "events"), (3, "COOLDOWN", False, "events")} <= seen[0]
    assert (3, "ACTIVE", False, "events") in seen[1] and not any(c == "timer" for *_, c in seen[1])
    assert {x for x in seen[2] if x[3] == "timer"} == {(1, "COOLDOWN", True, "timer")}
    assert {x[0] for x in seen[3] if x[3] == "forgotten"} == {1, 2, 3}


@pytest.mark.parametrize("build", [states.circuit_stream, states.fold_stream])
def test_calls_grow_with_buckets_and_not_with_users(spark, build):
    """A call of a processor costs a millisecond or more, so many users are one key of the state."""
    source, path = new_path(spark, "many-source"), new_path(spark, "many")
    made(spark, [(0, u, "error") for u in range(3 * 1024)]).write.parquet(source)
    stream = build(streams.read_events(spark, source, None))
    run = stream.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "many-offsets")).trigger(availableNow=True)
    run = run.foreachBatch(lambda rows, n: rows.write.mode("append").parquet(path)).start()
    run.awaitTermination()
    assert max(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]) <= 1024
    rows = spark.read.parquet(path)
    assert sorted((r.user_id, r.in_a_row) for r in rows.collect()) == [(u, 1) for u in range(3 * 1024)]


def test_users_of_one_bucket_keep_their_own_states(spark, some, monkeypatch):
    monkeypatch.setattr(states, "BUCKETS", 1)
    test_circuits_equal_the_batch_form_after_restarts(spark, some)
    test_fold_equals_the_batch_form(spark, some)
    test_timers_end_cooldowns_and_forget(spark)


@pytest.mark.parametrize("name", ["x5_stream_fold", "x6_circuit_stream"])
def test_replays_keep_no_more_stores_than_the_cores_need(spark, tmp_path, name):
    """A store costs a task in each micro-batch, so its number must not follow a setting that is made for large shuffles."""
    made(spark, [(0, u, "error") for u in range(500)]).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set(RUN, 40)
    rows = queries()[name](spark, str(tmp_path))
    assert 0 < len([x for x in rows.inputFiles() if "/n=0/" in x]) <= 2 * spark.sparkContext.defaultParallelism
    assert rows.count() == 500 and spark.conf.get(RUN) == "40"


@pytest.mark.parametrize("most", [7, 100_000])
def test_packets_hold_every_event(spark, monkeypatch, most):
    monkeypatch.setattr(states, "PACKED_ROWS", most)
    events = [(i % 3, i % 5, None if i % 7 == 0 else i, None if i % 11 == 0 else (1 << 60) + i, None if i % 13 == 0 else "error", None if i % 4 == 0 else i / 2) for i in range(400)]
    rows = spark.createDataFrame(events, "bucket long, user_id long, us long, event_id long, event_type string, value double").coalesce(1)
    packets = states.packed(rows).toPandas()
    assert len(packets) == 3 if most > 400 else len(packets) < 400
    lists = zip(*(packets[c] for c in packets.columns), strict=True)
    got = [(b, *x) for b, *columns in lists for x in zip(*(c.tolist() for c in columns), strict=True)]
    want = [(b, u, states.LAST if t is None else t, states.LAST if e is None else e, k, v) for b, u, t, e, k, v in events]
    assert sorted(map(repr, got)) == sorted(repr((*x[:5], float("nan") if x[5] is None else x[5])) for x in want)


def test_events_without_time_or_value_are_folded_last(spark):
    """More packets than one, of events whose times, values and kinds are missing here and there."""
    rows = [(i, None if i % 9 == 0 else START + dt.timedelta(minutes=400 - i), i % 3, ["click", "purchase", "error", None][i % 4], None if i % 5 == 0 else i / 4, "p") for i in range(400)]
    events = spark.createDataFrame(rows, SCHEMA)
    source, path = new_path(spark, "odd-source"), new_path(spark, "odd")
    events.repartition(3).write.parquet(source)
    streams.advance(states.fold_stream(streams.read_events(spark, source, None)), "update", path, new_path(spark, "odd-offsets"))
    got = {r.user_id: (r.attempts, r.successes, r.failures, r.in_a_row, r.times_opened, r.mean) for r in spark.read.parquet(f"{path}/n=*").collect()}
    want = {u: folds.SourceState() for u in range(3)}
    for i, ts, user, kind, value, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or START, r[0])):
        want[user].apply(kind, value)
    assert got == {u: (s.attempts, s.successes, s.failures, s.in_a_row, s.times_opened, s.mean) for u, s in want.items()}
