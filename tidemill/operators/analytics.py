"""Aggregates over articles, sources and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, time: str) -> DataFrame:
    """Rows for each day, with the day as text."""
    return events.groupBy(F.date_format(F.to_date(time), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def source_performance(articles: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Articles and mean score of each source; sources without a score have mean 0."""
    joined = articles.join(scores, key)
    return joined.groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("article_count"), F.coalesce(F.avg(F.col(score).cast("double")), F.lit(0.0)).alias("avg_score"))


def category_breakdown(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))


def score_distribution(df: DataFrame, score: Column, buckets: int = 10) -> DataFrame:
    """Counts of positive scores in equal buckets of [0, 1], empty ones included."""
    scored = df.select(score.alias("v")).where("v > 0")
    counts = scored.groupBy(F.least(F.floor(F.col("v") * buckets), F.lit(buckets - 1)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    all_buckets = df.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return all_buckets.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))  # counts has at most `buckets` rows


def day_stats(df: DataFrame, time: str, done: Column, score: str) -> DataFrame:
    """Collected, processed, rate in percent and mean score of each day, in one pass."""
    day = F.date_format(F.to_date(time), "yyyy-MM-dd").alias("day")
    out = df.groupBy(day).agg(F.count("*").alias("collected"), F.count_if(done).alias("processed"), F.avg(score).alias("avg_score"))
    return out.withColumn("rate", 100.0 * F.col("processed") / F.col("collected"))


def top_sources(df: DataFrame, source: str, score: str, k: int = 10) -> DataFrame:
    """The k sources of highest mean score."""
    out = df.groupBy(F.col(source).alias("source_id")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max(score).alias("best"))
    return out.orderBy(F.desc("mean"), "source_id").limit(k)


def health(df: DataFrame, pending: Column, failed: Column, most_pending: int = 100) -> DataFrame:
    """Totals and a status, one row."""
    out = df.agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if(failed).alias("failed"))
    return out.withColumn("status", F.when((F.col("failed") == 0) & (F.col("pending") < most_pending), "healthy").otherwise("degraded"))


def weighted_mean(df: DataFrame, group: str, score: str) -> DataFrame:
    """The count-weighted mean over groups' means."""
    per = df.groupBy(group).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    return per.agg(F.sum("n").alias("total"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


def shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """The share of each value in its group."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def missing_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows in which each column is null or blank."""
    means = df.agg(*[F.avg((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("double")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return means.selectExpr(f"stack({len(columns)}, {pairs}) AS (field, missing)")


def funnel(events: DataFrame, source: str, stage: str, stages: list[str]) -> DataFrame:
    """Events of each stage for each source, side by side, and the first failure."""
    counts = [F.count_if(F.col(stage) == s).alias(f"n_{s}") for s in stages]
    return events.groupBy(F.col(source).alias("source_id")).agg(*counts)


def percentiles(df: DataFrame, group: str, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Percentiles by linear interpolation between neighbours, exact for groups of any size.

    A sketch of bounded size brackets each rank; rows below a bracket are only counted, equal values inside it are counted
    together, and only those are ordered. So no task holds or sorts a group, however large it is.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    margin = 4.0 / accuracy
    sketch = lambda side: F.percentile_approx("v", F.array(*[F.lit(min(1.0, max(0.0, p + side * margin))) for p in at]), accuracy)
    marks = rows.groupBy("g").agg(F.count("*").alias("n"), sketch(-1).alias("low"), sketch(1).alias("high"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(at)])
    marks = marks.select("g", "n", "low", "high", F.explode(wanted).alias("w"))
    # a group of at most 10 * accuracy rows is its own bracket; in larger ones the margin spans many ranks
    small = F.col("n") <= 10 * accuracy
    low = F.when(small, F.lit(float("-inf"))).otherwise(F.get("low", F.col("w.i")))
    high = F.when(small, F.lit(float("inf"))).otherwise(F.get("high", F.col("w.i")))
    marks = marks.select("g", "n", "w.i", "w.p", low.alias("low"), high.alias("high"))
    # values are counted once before they meet the brackets
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    met = counted.alias("a").join(marks.alias("b"), F.expr("a.g <=> b.g")).select("a.g", "v", "c", "n", "i", "p", "low", "high")
    below = met.where("v < low").groupBy("g", "i").agg(F.sum("c").alias("below"))
    inside = met.where("v >= low AND v <= high")
    upto = Window.partitionBy("g", "i").orderBy("v")
    placed = inside.withColumn("upto", F.sum("c").over(upto)).alias("a").join(below.alias("b"), F.expr("a.g <=> b.g AND a.i = b.i"), "left")
    last = F.coalesce("b.below", F.lit(0)) + F.col("a.upto")  # ranks first .. last - 1 have this value
    first = last - F.col("a.c")
    rank = F.col("a.p") * (F.col("a.n") - 1)
    has = lambda r: (r >= first) & (r < last)
    ends = placed.groupBy("a.g", "a.i").agg(
        F.max(F.when(has(F.floor(rank)), F.col("a.v"))).alias("x"), F.max(F.when(has(F.ceil(rank)), F.col("a.v"))).alias("y"), F.first(rank - F.floor(rank)).alias("part")
    )
    value_at = F.col("x") + (F.col("y") - F.col("x")) * F.col("part")
    named = [F.max(F.when(F.col("i") == i, value_at)).alias(f"p{round(p * 100)}") for i, p in enumerate(at)]
    return ends.groupBy("g").agg(*named).withColumnRenamed("g", group)


def label_metrics(pairs: DataFrame, predicted: Column, gold: Column, group: str) -> DataFrame:
    """Precision, recall and F1 of a yes-no prediction in each group; 0 where undefined."""
    tp, fp, fn = F.count_if(predicted & gold), F.count_if(predicted & ~gold), F.count_if(~predicted & gold)
    out = pairs.groupBy(group).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)
