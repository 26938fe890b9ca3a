"""Reports of cycles, sources, rankings, metrics and monitoring, as grouped frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import failure_class
from tidemill.operators.monitoring import operational_state

#: How a failed fetch is named and what is advised, in order; sources that are known to be closed.
STATUSES = ((403, "HTTP 403 Forbidden", "headless"), (401, "HTTP 401 Unauthorized", "impossible"), (429, "HTTP 429 Rate Limit", "http (adjust rate)"))
CLOSED, OPEN_BLOGS = ("nature", "science", "nejm"), ("deepmind_blog", "openai_blog")
SEVERITIES = ("ok", "info", "warning", "critical")


def scoring_cycle(scored: DataFrame) -> DataFrame:
    """One row of a scoring cycle; scored has is_pending, score (null where scoring failed) and included."""
    done = F.col("score").isNotNull()
    out = scored.agg(
        F.count_if(done).alias("articles_scored"), F.count_if(done & F.col("is_pending")).alias("new_articles_scored"), F.count_if(done & ~F.col("is_pending")).alias("completed_articles_rescored"),
        F.count_if(done & F.col("included")).alias("articles_included"), F.count_if(done & ~F.col("included")).alias("articles_excluded"), F.count_if(~done).alias("failed"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
    )
    return out


def enrichment_failures(failures: DataFrame, fetches: DataFrame) -> DataFrame:
    """What failed in the latest session with failures: one row for each source, its first failing page classified.

    failures has session_id, time, seq, source_id, url, n_chars; of a url the last counts, in the place of its first.
    fetches has session_id, url, status, error, seq.
    """
    last = failures.groupBy("session_id").agg(F.max("time").alias("time")).orderBy(F.desc("time"), F.desc("session_id")).limit(1).select("session_id")
    own = failures.join(F.broadcast(last), "session_id", "left_semi")  # one row
    pages = own.groupBy("source_id", "session_id", "url").agg(F.min("seq").alias("first"), F.max_by("n_chars", "seq").alias("n_chars"))
    sample = pages.groupBy("source_id", "session_id").agg(F.count("*").alias("pages"), F.min_by(F.struct("url", "n_chars"), "first").alias("s")).select("source_id", "session_id", "pages", "s.*")
    held = fetches.groupBy("session_id", "url").agg(F.max_by(F.struct("status", "error"), "seq").alias("f")).select("session_id", "url", "f.*")
    rows = sample.join(held, ["session_id", "url"], "left")
    sid, n = F.col("source_id"), F.col("n_chars")
    chars = lambda name: F.format_string(f"{name} (%d chars)", n)
    kind, mode = F.when(sid.isin(*CLOSED), "Paywall/Bot-Protection").when(sid.isin(*OPEN_BLOGS), chars("Content Too Short")), F.when(sid.isin(*CLOSED), "impossible (or headless+auth)").when(sid.isin(*OPEN_BLOGS), "headless")
    for status, name, advice in STATUSES:
        kind, mode = kind.when(F.col("status") == status, name), mode.when(F.col("status") == status, advice)
    late = F.contains(F.lower("error"), F.lit("timeout"))
    kind = kind.when(late, "Timeout").when((n > 0) & (n < 100), chars("Empty/Stub")).otherwise("Content Too Short")
    mode = mode.when(late, "http (retry)").otherwise("headless")
    priority = F.when((F.col("status") == 403) | ((n > 0) & (n < 500)), 1).when(sid.isin(*CLOSED), 3).otherwise(2)
    return rows.select("source_id", "pages", kind.alias("failure_type"), mode.alias("recommended_mode"), priority.alias("priority"))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))


def production_report(metrics: DataFrame) -> DataFrame:
    """Yield and success rates of each source in percent, and the lock that they recommend."""
    c = F.col
    out = metrics.withColumn("yield_pct", percent(c("publishable"), c("attempted"))).withColumn("http_rate", percent(c("http_success"), c("http_attempts"))).withColumn("headless_rate", percent(c("headless_success"), c("headless_attempts")))
    better = (c("headless_rate") > c("http_rate") + 20) | ((c("http_rate") < 1) & (c("headless_rate") > 20))
    lock = F.when(c("attempted") < 5, None).when((c("headless_attempts") > 0) & better, "headless_fallback").when(F.try_divide(c("scholarly_success") * 100.0, c("scholarly_attempts")) > 50, "scholarly")
    return out.select("source_id", "attempted", "publishable", "yield_pct", "http_rate", "headless_rate", lock.alias("lock"))


def top_failures(history: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent (strategy, reason) of failed attempts."""
    return history.groupBy("strategy", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "strategy", "reason").limit(k)


def share_shift(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """value, before, after: the share of each value in a list before and after it is ranked again; 0 where it is not there."""
    def share(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(value).agg(F.count("*").alias("n"))
        return n.select(value, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # one row for each value

    return share(before, "before").join(share(after, "after"), value, "full_outer").na.fill(0.0, ["before", "after"])


def metric_snapshot(events: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Count, sum, least, greatest and last value of each metric and set of labels."""
    return events.groupBy(name, *labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def ingest_metrics(cycles: DataFrame) -> DataFrame:
    """name, value, source_id of the counters that collection emits for each source: articles and latency, or an error."""
    failed = F.col("error").isNotNull()
    found = F.when(failed, F.array(F.struct(F.lit("collector.ingest.error").alias("name"), F.lit(1.0).alias("value")))).otherwise(
        F.array(F.struct(F.lit("collector.ingest.count").alias("name"), F.col("articles").cast("double").alias("value")), F.struct(F.lit("collector.ingest.latency").alias("name"), F.col("latency").cast("double").alias("value")))
    )
    return cycles.select("source_id", F.explode(found).alias("m")).select("source_id", "m.name", "m.value")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(1)).cast("int")


def alert_payload(anomalies: DataFrame, alerts: DataFrame, group: list[str]) -> DataFrame:
    """One payload for each group: its status (of its alerts at warning or above, else of its anomalies), counts, and both
    lists as JSON, in the order of severity."""
    rank = severity_rank(F.col("severity"))
    item = F.struct(-rank, F.col("title"), F.to_json(F.struct("title", "severity", "target")).alias("json"))
    listed = lambda df, name: df.groupBy(*group).agg(
        F.max(rank).alias(f"{name}_rank"), F.count("*").alias(f"n_{name}"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x["json"]).alias(name)
    )
    both = listed(anomalies, "anomalies").join(listed(alerts, "alerts"), group, "full_outer").na.fill(0, ["n_anomalies", "n_alerts"])
    rank_of = F.when(F.col("alerts_rank") >= 3, F.col("alerts_rank")).otherwise(F.coalesce("anomalies_rank", F.lit(1)))
    status = F.element_at(F.array(*map(F.lit, SEVERITIES)), rank_of)
    return both.select(*group, status.alias("status"), "n_anomalies", "n_alerts", "anomalies", "alerts")


def health_record(observed: DataFrame) -> DataFrame:
    """One record for each source: what it found and saved, success rates by strategy, its failure class and state.

    observed has source_id, content_mode, found, saved, feed_ok, error, attempted, publishable, and attempts and success
    of plain_http, scrapling_http and scrapling_stealth; nulls count as 0, an unknown mode as `unknown`.
    """
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / F.greatest(b, F.lit(1)), 3))
    found, saved = n("found"), n("saved")
    mode, feed = F.coalesce("content_mode", F.lit("unknown")), F.coalesce("feed_ok", F.lit(False))
    rates = [ratio(n(f"{s}_success"), n(f"{s}_attempts")).alias(f"{s}_success_rate") for s in ("plain_http", "scrapling_http", "scrapling_stealth")]
    message = F.when(F.trim("error") != "", F.col("error"))
    return observed.select(
        "source_id", mode.alias("content_mode"), feed.alias("feed_ok"), (saved > 0).alias("content_ok"), found.alias("articles_found"), saved.alias("articles_saved"), ratio(saved, found).alias("save_ratio"),
        ratio(n("publishable"), n("attempted")).alias("publishable_ratio"), *rates, message.alias("last_error_message"), failure_class(message, saved, feed).alias("failure_taxonomy"),
        operational_state(mode, found, saved, ratio(saved, found)).alias("operational_state"),
    )


def routed(original: Column, lock: Column, hint: Column, headless: Column) -> Column:
    """(strategy, decision): a lock goes before a hint before the configured way, where the source allows it.

    Browsers need the source's leave; a proxy is only suggested; plain http never takes the place of scholarly.
    """
    base, wanted = F.coalesce(original, F.lit("http")), F.coalesce(lock, hint)
    by, leave = F.when(lock.isNotNull(), "lock").otherwise("hint"), F.coalesce(headless, F.lit(False))
    browser = wanted.isin("headless_fallback", "scrapling_stealth")
    takes = (browser & leave) | (wanted == "scholarly") | ((wanted == "http") & (base != "scholarly"))
    strategy = F.when(F.coalesce(takes, F.lit(False)), wanted).otherwise(base)
    decision = (
        F.when(wanted.isNull(), "config").when((wanted == "headless_fallback") & ~leave, F.concat(by, F.lit("_rejected"))).when(wanted == "proxy_auto", F.concat(by, F.lit("_suggested")))
        .when(strategy != base, F.concat(by, F.lit("_applied"))).otherwise("unchanged")
    )
    return F.struct(strategy.alias("strategy"), decision.alias("decision"))


def weekly_report(outages: DataFrame, drifts: DataFrame, shifts: DataFrame, source: str) -> DataFrame:
    """source, detector, severity, n of all findings of a week, worst first in each source, without what is well."""
    frames = [df.select(source, F.lit(name).alias("detector"), "severity") for name, df in (("outage", outages), ("schema_drift", drifts), ("content_shift", shifts))]
    found = frames[0].unionByName(frames[1]).unionByName(frames[2]).where("severity <> 'ok'")
    return found.groupBy(source, "detector", "severity").agg(F.count("*").alias("n"))


def cycle_traces(events: DataFrame, trace: str, time: str, kind: str, order: str) -> DataFrame:
    """One row for each trace: events, errors, first and last kind, and its length in seconds."""
    at = F.struct(time, order)
    return events.groupBy(trace).agg(
        F.count("*").alias("n_events"), F.count_if(F.col(kind) == "error").alias("n_errors"), F.min_by(kind, at).alias("first_kind"), F.max_by(kind, at).alias("last_kind"),
        ((F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / 1e6).alias("seconds"),
    )


def health_checks(checks: DataFrame) -> DataFrame:
    """One row of all checks: how many passed, warned and failed; failed if one failed, degraded if one warned."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = checks.agg(n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "unhealthy").when(F.col("warned") > 0, "degraded").otherwise("healthy"))


def read_model(recent: DataFrame, performance: DataFrame, k: int = 5) -> DataFrame:
    """One row: the recent articles, the mean score of all articles over the number of recent ones (the windows differ on
    purpose, as dashboards show it), and the k best sources."""
    total = recent.agg(F.count("*").alias("total_articles"))
    whole = performance.agg(F.sum(F.col("avg_score") * F.col("article_count")).alias("points"))
    best = performance.orderBy(F.desc("avg_score"), "source_id").limit(k)
    top = best.agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("avg_score"), "source_id"))), lambda x: x["source_id"]).alias("top_sources"))
    joined = total.crossJoin(whole).crossJoin(top)  # one row each
    return joined.select("total_articles", F.coalesce(F.try_divide("points", "total_articles"), F.lit(0.0)).alias("avg_score_overall"), "top_sources")
