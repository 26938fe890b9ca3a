"""Queries of the streaming forms: events are replayed in the order of time, and each stream runs over them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.bindings import table
from tidemill.plans.registry import query
from tidemill.streaming import events as streams
from tidemill.streaming import sources_state as states


def lossless(found: tuple[DataFrame, int]) -> DataFrame:
    """The result of a replay, of which no event may have come too late."""
    rows, late = found
    if late:
        raise ValueError(f"{late} events came after the watermark")
    return rows


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x1_tumbling_windows(spark, d):
    found = lossless(streams.replayed(table(spark, d, "events"), streams.tumbling, "complete", "tumbling"))
    return found.drop("batch").withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) SELECT strftime(start, '%Y-%m-%d') AS day, count(*) AS n FROM w GROUP BY 1")
def x2_sliding_windows(spark, d):
    return lossless(streams.replayed(table(spark, d, "events"), streams.sliding, "complete", "sliding")).drop("batch")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def x3_session_windows(spark, d):
    rows = table(spark, d, "events")
    found = lossless(streams.replayed(rows, streams.sessions, "append", "sessions", last=streams.one_event(rows)))
    return found.where("user_id <> -1").drop("batch")


@query("SELECT event_id, user_id FROM events")
def x4_fresh_events(spark, d):
    """Each event is delivered twice."""
    rows = table(spark, d, "events")
    return lossless(streams.replayed(rows.unionAll(rows), streams.fresh, "append", "fresh")).select("event_id", "user_id")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def x5_stream_fold(spark, d):
    found = lossless(streams.replayed(table(spark, d, "events"), states.fold_stream, "update", "fold", stores=states.STORES))
    return found.groupBy("user_id").agg(F.max_by("failures", "batch").alias("failures"))


@query("""WITH l AS (SELECT user_id, max(struct_pack(t := ts, e := event_id)) FILTER (event_type = 'purchase') AS reset FROM events GROUP BY 1),
  o AS (SELECT e.* FROM events e JOIN l USING (user_id) WHERE reset IS NULL OR struct_pack(t := ts, e := event_id) > reset),
  p AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n, max(ts) FILTER (event_type = 'error') AS since, arg_max(substr('failed with ' || props, 1, 500), struct_pack(t := ts, e := event_id)) FILTER (event_type = 'error') AS message FROM o GROUP BY 1)
  SELECT l.user_id, coalesce(n, 0) AS in_a_row, CASE WHEN coalesce(n, 0) >= 3 THEN 'COOLDOWN' ELSE 'ACTIVE' END AS state, CASE WHEN n >= 3 THEN strftime(since + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') END AS retry_at, CASE WHEN n > 0 THEN message END AS last_error,
    coalesce(n, 0) >= 3 AS due FROM l LEFT JOIN p USING (user_id)""")
def x6_circuit_stream(spark, d):
    """At the end an event follows a year later, so every circuit that is open then is marked due by its timer."""
    rows = table(spark, d, "events")
    found = lossless(streams.replayed(rows, states.circuit_stream, "update", "circuits", last=streams.one_event(rows), stores=states.STORES))
    # of one micro-batch, timers run after events
    newest = F.max_by(F.struct("in_a_row", "state", "retry_ms", "last_error", "due"), F.struct("batch", F.col("cause") != "events")).alias("s")
    now = found.where("user_id <> -1").groupBy("user_id").agg(newest).select("user_id", "s.*")
    return now.withColumn("retry_at", F.date_format(F.timestamp_millis("retry_ms"), "yyyy-MM-dd HH:mm:ss")).drop("retry_ms")
