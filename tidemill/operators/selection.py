"""Choosing candidates: rankings, preselections, chunks for prompts, pages appended, cached values first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Content characters that a prompt holds of an article.
PROMPT_CONTENT = 800


def ranked_candidates(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows by (score desc, key), with their place; the window sees k rows."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key)))


def preselect(df: DataFrame, picked: DataFrame, score: str, key: str, at: str, k: int) -> DataFrame:
    """k keys: those picked, in their order (ties: by key), repeats and unknown keys left out, then the best of the others by score."""
    first = picked.groupBy(key).agg(F.min(at).alias("at"))
    rows = df.join(first, key, "left").select(key, F.col("at").isNotNull().alias("picked"), F.coalesce("at", F.lit(0)).alias("at"), F.when(F.col("at").isNull(), F.col(score)).alias(score))
    order = [F.desc("picked"), F.col("at"), F.desc(score), F.col(key)]
    return rows.orderBy(*order).limit(k).select(key, F.row_number().over(Window.orderBy(*order)).alias("place"), "picked")


def prompt_size(title: Column, summary: Column, content: Column) -> Column:
    """The length of the text that stands for an article in a prompt."""
    known = lambda c: F.coalesce(c, F.lit(""))
    return F.length(F.concat(F.lit("Title: "), known(title), F.lit("\nSummary: "), known(summary), F.lit("\nContent: "), F.substring(known(content), 1, PROMPT_CONTENT)))


def chunks(df: DataFrame, group: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """group, order, chunk: rows of a group, in order, fill chunks of bounded count and size; a row above the bound is alone.

    One pass over rows sorted within partitions: only the state of one open chunk is held, so a group may have any size.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, chunk, items, total = None, 0, 0, 0
        for frame in batches:
            numbers = []
            for g, s in zip(frame[group].tolist(), frame[size].tolist()):
                if g != current:
                    current, chunk, items, total = g, 0, 0, 0
                elif items and (items >= most_items or total + s > most_size):
                    chunk, items, total = chunk + 1, 0, 0
                items, total = items + 1, total + s
                numbers.append(chunk)
            yield frame[[group, order]].assign(chunk=numbers)

    rows = df.select(group, order, size).repartition(group).sortWithinPartitions(group, order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(fill, f"{group} {kinds[group]}, {order} {kinds[order]}, chunk long")


def append_pages(pages: list[DataFrame]) -> DataFrame:
    """Pages one after the other, columns by name; what a page lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def published_view(df: DataFrame) -> DataFrame:
    """An article as it is published: without its metadata."""
    return df.drop("article_metadata")


def with_cache(df: DataFrame, cache: DataFrame, key: str, value: str, compute: Column) -> DataFrame:
    """df with value from the cache where it is known, else computed, and whether it was."""
    held = cache.groupBy(F.col(key)).agg(F.max(value).alias("_held"))
    return df.join(held, key, "left").withColumn(value, F.coalesce("_held", compute)).withColumn("cached", F.col("_held").isNotNull()).drop("_held")
