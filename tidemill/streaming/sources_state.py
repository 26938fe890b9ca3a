"""State of each source kept by a stream: the metrics fold and the circuit breaker, with timers.

Both are processors of transformWithStateInPandas over a RocksDB state store, so a key's state lives outside the worker's memory,
survives restarts with the checkpoint and can be read by timers when no event comes. A key is a bucket of users, since each
call and each request to the store costs a millisecond or more, however few events a user has: the states of a bucket are read,
moved and written as one. Each state store costs a task of a second or more in each micro-batch, so replays of these streams
keep STORES for each core at most. Rows of one user in a micro-batch are applied in order of time; the batch forms in operators/
give the same final states.

Spark hands a worker with state its rows one by one, so the fold gets them in packets: the events of a bucket, of many that a
task reads, as one row of lists. The circuits do not, since events that are late are told apart by their rows.

Timers run on event time. A circuit that has opened is marked due when the watermark passes its time of retry, without
any event of that source. A source that is idle for `forget` is dropped from the state. A bucket has one timer, for what
comes first; when it runs, all is done that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.folds import OPEN_AFTER, STATE, SourceState
from tidemill.session import MOST_BYTES

COOLDOWN_MS = 4 * 3600 * 1000
MESSAGE = 500
CIRCUIT = "in_a_row long, opened_ms long, retry_ms long, last_error string, idle_ms long, due boolean"
CIRCUIT_ROWS = "user_id long, in_a_row long, state string, retry_ms long, last_error string, due boolean, cause string"
BUCKETS = 1024
STORES = 2  # for each core
PACKED_ROWS = 100_000  # events that a task holds to make packets of, of MOST_BYTES at most
PACKETS = "bucket long, user_id array<long>, us array<long>, event_id array<long>, event_type array<string>, value array<double>"
LAST = (1 << 63) - 1  # unknown times and ids come last, as in pandas
NEVER_MS = -(1 << 63) // 1_000_000  # of an unknown time


def bucket(user: str = "user_id") -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).alias("bucket")


def packed(rows: DataFrame) -> DataFrame:
    """The columns of PACKETS, event by event, as packets."""

    def packets(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(held).sort_by("bucket").combine_chunks().to_batches()[0]
        buckets = found["bucket"].to_numpy()
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        ends = pa.array([*starts.tolist(), len(buckets)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, found[c]) for c in found.schema.names[1:]]
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts]), *lists], names=found.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, full = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, size, full = [*held, batch], size + batch.num_rows, full + batch.nbytes
            if size >= PACKED_ROWS or full >= MOST_BYTES:
                yield packets(held)
                held, size, full = [], 0, 0
        if held:
            yield packets(held)

    return rows.withColumns({c: F.coalesce(c, F.lit(LAST)) for c in ("us", "event_id")}).mapInArrow(run, PACKETS)


def unpacked(packets: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(packets[c].tolist()) for c in packets.columns if c != "bucket"})


def all_of(state: str) -> str:
    """The schema of the states of a bucket."""
    return f"users array<struct<user_id: long, {', '.join(': '.join(x.split()) for x in state.split(', '))}>>"


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = dict(x.split() for x in schema.split(", "))
    made = pd.DataFrame(rows, columns=list(kinds), dtype=object)
    return made.astype({c: {"long": "Int64", "double": "float64"}[k] for c, k in kinds.items() if k in ("long", "double")})


def in_order(rows: Iterator[pd.DataFrame], last: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Each user with (user, type, microseconds, the field `last`) of each row in order of time."""
    found = pd.concat(list(rows)).sort_values(["user_id", "us", "event_id"])
    return groupby(zip(*(found[c].tolist() for c in ("user_id", "event_type", "us", last)), strict=True), itemgetter(0))


class Buckets(StatefulProcessor):
    """States of users by the bucket."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", all_of(self.state))

    def held(self) -> dict[int, tuple]:
        found = self.now.get()
        return {user: tuple(state) for user, *state in found[0]} if found else {}

    def hold(self, states: dict[int, tuple]) -> None:
        if states:
            self.now.update(([(user, *state) for user, state in states.items()],))
        else:
            self.now.clear()

    def close(self) -> None:
        pass


class MetricsFold(Buckets):
    """The counters and running mean of each source after each micro-batch."""

    state = STATE

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states, moved = self.held(), []
        for user, events in in_order(map(unpacked, rows), "value"):
            state = SourceState(*states.get(user, ()))
            for _, kind, _, value in events:
                state.apply(kind, None if pd.isna(value) else value)
            states[user] = astuple(state)
            moved.append((user, *states[user]))
        self.hold(states)
        yield frame(moved, f"user_id long, {STATE}")


class Circuit(Buckets):
    """Failures in a row open the circuit until a time of retry; a success closes it; timers mark what is due and forget what is idle."""

    state = CIRCUIT

    def __init__(self, failure: str = "error", success: str = "purchase", cooldown_ms: int = COOLDOWN_MS, forget_ms: int | None = None) -> None:
        self.failure, self.success, self.cooldown_ms, self.forget_ms = failure, success, cooldown_ms, forget_ms

    def told(self, user: int, state: tuple, cause: str) -> tuple:
        in_a_row, _, retry, error, _, due = state
        return (user, in_a_row, "COOLDOWN" if in_a_row >= OPEN_AFTER else "ACTIVE", retry, error, due, cause)

    def first(self, states: dict[int, tuple]) -> int | None:
        """The time of the bucket's timer."""
        times = [t for _, _, retry, _, idle, due in states.values() for t in (None if due else retry, idle) if t is not None]
        return min(times, default=None)

    def moved(self, old: int | None, new: int | None) -> None:
        """Replace a timer."""
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states, told, seen = self.held(), [], timerValues.getCurrentWatermarkInMs()
        timer = self.first(states)
        for user, events in in_order(rows, "props"):
            in_a_row, opened, retry, error, idle, due = states.get(user, (0, None, None, None, None, False))
            for _, kind, us, props in events:
                last = NEVER_MS if pd.isna(us) else int(us) // 1000
                if kind == self.success:
                    in_a_row, opened, retry, error, due = 0, None, None, None, False
                elif kind == self.failure:
                    in_a_row, opened, error = in_a_row + 1, last, f"failed with {props}"[:MESSAGE]
                    if in_a_row >= OPEN_AFTER:
                        retry, due = last + self.cooldown_ms, False
            if retry is not None and not due and retry <= seen:
                due = True  # a timer in the past would not run
            states[user] = (in_a_row, opened, retry, error, last + self.forget_ms if self.forget_ms else None, due)
            told.append(self.told(user, states[user], "events"))
        self.hold(states)
        self.moved(timer, self.first(states))
        yield frame(told, CIRCUIT_ROWS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states, told, seen = self.held(), [], timerValues.getCurrentWatermarkInMs()
        for user, (in_a_row, opened, retry, error, idle, due) in list(states.items()):
            gone = idle is not None and idle <= seen
            if retry is not None and not due and retry <= seen and not (gone and idle <= retry):
                states[user] = (in_a_row, opened, retry, error, idle, True)
                told.append(self.told(user, states[user], "timer"))
            if gone:
                del states[user]
                told.append(self.told(user, (0, None, None, None, None, False), "forgotten"))
        self.hold(states)
        self.moved(None, self.first(states))  # the one that has run goes by itself
        if told:
            yield frame(told, CIRCUIT_ROWS)


def with_state_store(spark: SparkSession) -> None:
    """transformWithState needs RocksDB; the setting holds for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold_stream(events: DataFrame) -> DataFrame:
    """The state of each user after each micro-batch; events of a batch are applied in order of time."""
    with_state_store(events.sparkSession)
    rows = events.select(bucket(), "user_id", F.unix_micros("ts").alias("us"), "event_id", "event_type", "value").where("user_id IS NOT NULL")
    return packed(rows).groupBy("bucket").transformWithStateInPandas(MetricsFold(), f"user_id long, {STATE}", "Update", "None")


def circuit_stream(events: DataFrame, late: str = "1 hour", **how: Any) -> DataFrame:
    """The circuit of each user after each micro-batch and after each timer."""
    with_state_store(events.sparkSession)
    rows = events.withWatermark("ts", late).select(bucket(), "user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "event_type", "props")
    return rows.where("user_id IS NOT NULL").groupBy("bucket").transformWithStateInPandas(Circuit(**how), CIRCUIT_ROWS, "Update", "EventTime")
