"""Ranked lists: top-k, keyset pages, latest rows, related articles, capped reranking, ranking measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, least: float, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return df.where(F.col(score) >= least).orderBy(F.desc(score), F.desc(key)).limit(k)


def after_cursor(score: Column, key: Column, last_score: float, last_key: int) -> Column:
    """Rows behind a cursor in an order by (score desc, null as 0, key desc).

    Written out for nulls, so that the scan is asked of the column itself and may leave row groups out.
    """
    below, level = score < last_score, score == last_score
    if last_score > 0:
        below = below | score.isNull()
    if last_score == 0:
        level = level | score.isNull()
    return below | (level & (key < last_key))


def feed_page(df: DataFrame, size: int, cursor: tuple[float, int] | None = None, score: str = "score", key: str = "id") -> DataFrame:
    """A page and one row more, which says whether there is another page."""
    rows = df if cursor is None else df.where(after_cursor(F.col(score), F.col(key), *cursor))
    ranked = F.coalesce(F.col(score), F.lit(0.0))
    return rows.withColumn("rank_score", ranked).orderBy(F.desc("rank_score"), F.desc(key)).limit(size + 1)


def oldest_page(df: DataFrame, time: str, key: str, after: tuple[object, int], size: int) -> DataFrame:
    """An ascending keyset page behind (time, key)."""
    t, k = after
    return df.where((F.col(time) > F.lit(t)) | ((F.col(time) == F.lit(t)) & (F.col(key) > k))).orderBy(time, key).limit(size)


def keyset_page(df: DataFrame, time: str, key: str, after: tuple[object, int], size: int) -> DataFrame:
    """A page of oldest_page with has_more: one row more is looked at, and not returned. The window sees a page."""
    rows = oldest_page(df, time, key, after, size + 1)
    w = Window.orderBy(time, key)
    ranked = rows.withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.where(F.col("place") <= size).withColumn("has_more", F.col("n") > size).drop("n")


def latest(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The last row of each group; partial maxima are combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in order], F.struct(*df.columns).alias("row"))
    return df.groupBy(group).agg(F.max(whole).alias("last")).select("last.row.*")


def top_in_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts each partition to k rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def related(df: DataFrame, cluster: str, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """Up to k other members of each member's cluster, best first; clusters are first cut to k + 1 members."""
    best = top_in_group(df.withColumn("s", F.coalesce(F.col(score), F.lit(0.0))), cluster, [F.desc("s"), F.desc(key)], k + 1)
    other = best.select(F.col(cluster).alias("c"), F.col(key).alias("other"), "rank")
    pairs = df.select(cluster, key).join(other, F.col(cluster) == F.col("c")).where(F.col(key) != F.col("other"))
    w = Window.partitionBy(key).orderBy("rank")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(key, "other", "place")


def capped(df: DataFrame, k: int, source_cap: float, topic_cap: float, score: str = "score", key: str = "id", seed: int = 1337, first: int = 1024) -> DataFrame:
    """place, score, id, source, topics of a greedy list of k rows in which no source and no topic takes more than its cap.

    Rows come by score, then date of publication (a string column `published`, if there is one), then source, all
    descending; full ties by a hash of key and seed. A row is passed over if its source, or any of its topics, is full;
    rows without topics meet the source's cap alone. What is chosen depends on the rows before it only, so a prefix of
    the order is folded that grows until the list is full: no more than that is ever collected. Rows of one source and
    one set of topics behind as many better ones as the caps allow can never be chosen and are left out before.
    """
    most_source, most_topic = max(1, int(k * source_cap)), max(1, int(k * topic_cap))
    published = F.col("published") if "published" in df.columns else F.lit("")
    topics = F.coalesce(F.array_sort(F.array_distinct("topics")), F.array().cast("array<string>"))
    rows = df.select(F.col(score).cast("double").alias("score"), F.coalesce(published, F.lit("")).alias("published"), F.coalesce("source", F.lit("unknown")).alias("source"),
                     F.xxhash64(key, F.lit(seed)).alias("tie"), F.col(key).cast("bigint").alias("id"), topics.alias("topics"))
    order = [F.desc(c) for c in ("score", "published", "source", "tie", "id")]
    near = top_in_group(rows.withColumn("pair", F.struct("source", "topics")), "pair", order, most_source).drop("rank", "pair")
    item = "struct<score:double,published:string,source:string,tie:bigint,id:bigint,topics:array<string>>"

    def step(taken: Column, x: Column) -> Column:
        of_source = F.size(F.filter(taken, lambda t: t["source"] == x["source"]))
        full = F.exists(x["topics"], lambda topic: F.size(F.filter(taken, lambda t: F.array_contains(t["topics"], topic))) >= most_topic)
        return F.when((F.size(taken) < k) & (of_source < most_source) & ~full, F.array_append(taken, x)).otherwise(taken)

    while True:
        prefix = near.orderBy(*order).limit(first)
        whole = prefix.agg(F.sort_array(F.collect_list(F.struct(*rows.columns)), asc=False).alias("rows"))
        folded = whole.select(F.size("rows").alias("n"), F.aggregate("rows", F.array().cast(f"array<{item}>"), step).alias("taken"))
        n, taken = folded.select("n", F.size("taken")).first()
        if taken >= k or n < first:
            break
        first *= 8
    chosen = folded.select(F.posexplode("taken").alias("place", "t"))
    return chosen.select((F.col("place") + 1).alias("place"), "t.score", "t.id", "t.source", "t.topics")


def precision_at(df: DataFrame, query: str, score: str, positive: str, key: str, k: int) -> DataFrame:
    """The share of positives among the first k rows of each query, of as many as there are."""
    best = top_in_group(df, query, [F.desc(score), F.col(key)], k)
    return best.groupBy(query).agg((F.count_if(F.col(positive)) / F.count("*")).alias("precision"))


def ranking_measures(df: DataFrame, query: str, score: str, relevance: str, key: str, k: int) -> DataFrame:
    """DCG, NDCG and precision at k, and the reciprocal rank of the first relevant row, for each query."""
    given = Window.partitionBy(query).orderBy(F.desc(score), key)
    ideal = Window.partitionBy(query).orderBy(F.desc(relevance), key)
    rows = df.withColumn("i", F.row_number().over(given)).withColumn("best", F.row_number().over(ideal))
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    dcg = F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1)).otherwise(0.0))
    idcg = F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1)).otherwise(0.0))
    out = rows.groupBy(query).agg(
        dcg.alias("dcg"), idcg.alias("idcg"), (F.count_if((F.col("i") <= k) & (F.col(relevance) > 0)) / k).alias("precision"),
        F.coalesce(1 / F.min(F.when(F.col(relevance) > 0, F.col("i"))), F.lit(0.0)).alias("reciprocal_rank"),
    )
    return out.withColumn("ndcg", F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg"))).drop("idcg")
