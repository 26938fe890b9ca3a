"""Explanations of scores, category resolution, catalogue audits and log reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_components(components: Column, k: int = 3) -> Column:
    """The k largest entries of a map of scores, as `Name score 0.00`."""
    pairs = F.sort_array(F.transform(F.map_entries(components), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))), asc=False)
    return F.transform(F.slice(pairs, 1, k), lambda p: F.format_string("%s score %.2f", F.initcap(F.replace(p["k"], F.lit("_"), F.lit(" "))), p["v"]))


def why_ranked(strengths: Column, factors: Column, components: Column, default: str = "Ranked by overall score") -> Column:
    """The first of: strengths, factors, top components, a default; at most three lines."""
    filled = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.slice(a, 1, 3))
    return F.coalesce(filled(strengths), filled(factors), filled(top_components(components)), F.array(F.lit(default)))


def assessment(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def resolve_category(given: Column, direct: dict[str, str], guess: Column, generic: tuple[str, ...] = ("general", "news"), default: str = "CIENCIA") -> Column:
    """A direct name unless generic, then a classifier's guess, then the default."""
    key = F.regexp_replace(F.lower(F.trim(given)), "[^a-z0-9]+", "_")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in direct.items() for x in pair]), key)
    return F.coalesce(F.when(~key.isin(*generic), named), guess, F.lit(default))


def audit_sources(sources: DataFrame) -> DataFrame:
    """Sources with the list of rules that they break."""
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.col("url"), F.lit("")) == "", "missing_url"),
        F.when(~F.col("credibility_score").between(0, 1), "credibility_out_of_range"),
        F.when((F.col("strategy") == "headless") & ~F.col("headless_enabled"), "headless_disabled"),
        F.when((F.col("content_mode") == "summary_only") & (F.col("strategy") != "rss"), "summary_needs_no_fetch"),
    ))
    return sources.withColumn("issues", issues).where(F.size("issues") > 0)


def last_run(log: DataFrame, start: str = "cycle started") -> DataFrame:
    """The lines of a log since the last start of a cycle; one bounded value, the time of it, is joined to all lines."""
    begun = log.where(F.contains(F.lower("message"), F.lit(start))).agg(F.max("time").alias("begun"))
    return log.join(F.broadcast(begun), F.col("time") >= F.coalesce("begun", F.lit(""))).drop("begun")  # one row


def source_report(log: DataFrame) -> DataFrame:
    """Found, saved, failed and publishable articles for each source of a log's last run."""
    n = lambda word: F.coalesce(F.sum(F.try_to_number(F.regexp_extract("message", rf"{word}=(\d+)", 1), F.lit("9999999999"))), F.lit(0)).cast("long")
    lines = last_run(log).withColumn("source_id", F.regexp_extract("message", r"source=(\S+)", 1)).where("source_id <> ''")
    out = lines.groupBy("source_id").agg(n("found").alias("found"), n("saved").alias("saved"), n("failed").alias("failed"))
    return out.withColumn("publishable", F.greatest(F.lit(0), F.col("saved") - F.col("failed")))


def outliers_of_clusters(df: DataFrame, cluster: str, key: str, hash_: str, most: int = 20) -> DataFrame:
    """Members of a cluster farther than `most` bits from its first member: they leave it."""
    anchor = df.where(F.col(hash_).isNotNull()).groupBy(cluster).agg(F.min_by(hash_, key).alias("anchor"))
    far = df.join(anchor, cluster).withColumn("distance", F.bit_count(F.col(hash_).bitwiseXOR(F.col("anchor"))))
    return far.where(F.col("distance") > most).select(cluster, key, "distance")


def best_matches(pairs: DataFrame, rows: DataFrame, key: str, time: str) -> DataFrame:
    """The best earlier match of each row: least distance, then least time apart (unknown last), then the newest id."""
    a, b = rows.select(F.col(key).alias("id"), F.col(time).alias("t")), rows.select(F.col(key).alias("other"), F.col(time).alias("u"))
    joined = pairs.join(a, "id").join(b, "other").withColumn("apart", F.abs(F.unix_micros("t") - F.unix_micros("u")))
    w = Window.partitionBy("other").orderBy("distance", F.col("apart").asc_nulls_last(), F.desc("id"))
    return joined.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("other").alias("id"), F.col("id").alias("match"), "distance")


def latest_known(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last non-null value of each column, for each key."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
