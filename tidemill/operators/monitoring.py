"""Source health, strategy choice, outages, drift, canaries and suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failures in a row that open a circuit, hours until it is tried again, characters that are kept of an error.
OPEN_AFTER, WAIT_H, MOST_MESSAGE = 3, 4, 500


def outages(windows: DataFrame, baselines: DataFrame, on: list[str]) -> DataFrame:
    """Severity of each window against its baseline: failures first, then the share of expected rows."""
    joined = windows.join(baselines, on)
    ratio = F.try_divide(F.col("found"), F.col("expected"))
    severity = F.when(F.col("failures") >= 3, "critical").when(ratio <= 0.2, "critical").when(ratio <= 0.5, "warning").otherwise("ok")
    return joined.withColumn("ratio", ratio).withColumn("severity", severity)


def jensen_shannon(current: DataFrame, base: DataFrame, group: str, value: str) -> DataFrame:
    """The divergence in bits of two distributions (group, value, share) of each group."""
    p = current.select(group, value, F.col("share").alias("p"))
    q = base.select(group, value, F.col("share").alias("q"))
    both = p.join(q, [group, value], "full_outer").select(group, value, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0)
    return both.groupBy(group).agg((F.sum(part("p") + part("q")) / 2).alias("divergence"))


def severity_of(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok")


def drift_severity(missing: Column, mistyped: Column, most_missing: float = 0.05, most_mistyped: float = 0.02) -> Column:
    """A schema's drift by the shares of missing and of mistyped values."""
    return F.when(missing > most_missing, "critical").when(mistyped > most_mistyped, "warning").otherwise("ok")


def canaries(windows: DataFrame, least: int, idle: Column, most_idle_h: float) -> DataFrame:
    reason = F.when(idle > most_idle_h, "idle").when(F.col("found") < least, "too_few")
    return windows.withColumn("canary", F.coalesce(reason, F.lit("pass")))


def suppressions(alerts: DataFrame, source: str) -> DataFrame:
    """Sources to suppress: two critical alerts, two days idle, or two failures."""
    per = alerts.groupBy(source).agg(F.count_if(F.col("severity") == "critical").alias("criticals"), F.max("idle_h").alias("idle_h"), F.max("failures").alias("failures"))
    return per.where((F.col("criticals") >= 2) | (F.col("idle_h") >= 48) | (F.col("failures") >= 2))


def strategy(attempts: Column, http: Column, headless: Column, proxy: Column, gain: Column) -> Column:
    """The recommended way to fetch, from success rates in percent."""
    return (
        F.when(attempts < 5, "insufficient").when(http > 80, "http").when((headless > 50) & (headless > http), "headless")
        .when((proxy > 50) & (proxy > F.greatest(http, headless)), "proxy").when((gain < 10) & (attempts > 10), "review").otherwise("keep")
    )


def crawl_gate(state: Column, now: Column, retry: Column, checked: Column, interval_h: float) -> Column:
    wait = F.unix_micros(now) - F.unix_micros(checked) < F.lit(int(interval_h * 3_600_000_000))
    return F.when((state == "COOLDOWN") & (now < retry), "cooldown").when(wait, "too_soon").otherwise("go")


def live_drift(current: DataFrame, base: DataFrame, key: str, drop: float = 0.3) -> DataFrame:
    """Keys whose ratio fell by at least `drop` against the baseline, or that broke."""
    joined = current.join(base, key, "left")
    reasons = [F.when((F.col("base_ratio") > 0) & (F.col("ratio") == 0), "newly_broken"), F.when(F.col("base_ratio") - F.col("ratio") >= drop, "ratio_drop")]
    return joined.withColumn("reason", reduce(lambda a, b: F.coalesce(a, b), reasons)).where("reason IS NOT NULL")


def islands(events: DataFrame, group: str, order: list[str], kind: str) -> DataFrame:
    """Runs of equal neighbours in each group: their first row's number, kind and length."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = events.withColumn("n", F.row_number().over(w)).withColumn("fresh", F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "run").agg(F.min("n").alias("start"), F.first(kind).alias("kind"), F.count("*").alias("length"))


def operational_state(mode: Column, found: Column, saved: Column, ratio: Column) -> Column:
    """Four states of a source from what it found and saved."""
    return (
        F.when((saved > 0) & (mode == "full_text") & (ratio >= 0.8), "healthy_full_text")
        .when((saved > 0) & mode.isin("summary_only", "summary_fallback") & (ratio >= 0.5), "healthy_summary_only")
        .when((found > 0) | (saved > 0), "partial_yield_flaky").otherwise("failing_suppressed_candidate")
    )


def circuit_states(events: DataFrame, key: str, order: list[str], failed: Column, succeeded: Column, message: Column, forced: Column | None = None) -> DataFrame:
    """key, in_a_row, state, retry_at, last_error of each source: failures since its last success open the circuit.

    A success resets it; from OPEN_AFTER failures in a row on it is in COOLDOWN, until WAIT_H hours after the last of them;
    a forced cooldown counts as that many. Messages keep MOST_MESSAGE characters. The first of order is a time. Two
    groupings with map-side sums: no task sees the events of a source in order.
    """
    at = F.struct(*order)
    rows = events.select(key, at.alias("at"), failed.alias("failed"), succeeded.alias("succeeded"), F.substring(message, 1, MOST_MESSAGE).alias("message"), (forced if forced is not None else F.lit(False)).alias("forced"))
    last = rows.where("succeeded").groupBy(key).agg(F.max("at").alias("reset"))
    open_ = rows.join(last, key, "left").where(F.col("reset").isNull() | (F.col("at") > F.col("reset")))
    bad = F.col("failed") | F.col("forced")
    per = open_.groupBy(key).agg(F.count_if("failed").alias("in_a_row"), F.max("forced").alias("forced"), F.max(F.when(bad, F.col(f"at.{order[0]}"))).alias("since"), F.max_by("message", F.when(F.col("failed"), F.col("at"))).alias("last_error"))
    every = rows.select(key).distinct().join(per, key, "left")
    n = F.greatest(F.coalesce("in_a_row", F.lit(0)), F.when(F.coalesce("forced", F.lit(False)), OPEN_AFTER).otherwise(0))
    state = F.when(n >= OPEN_AFTER, "COOLDOWN").otherwise("ACTIVE")
    return every.select(key, n.cast("long").alias("in_a_row"), state.alias("state"), F.when(n >= OPEN_AFTER, F.col("since") + F.expr(f"INTERVAL {WAIT_H} HOURS")).alias("retry_at"), F.when(n > 0, F.col("last_error")).alias("last_error"))
