"""Pictures of pages, from their node tables: those named in a page's head, then those in its article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.urls import joined_url
from tidemill.operators.dedup import written
from tidemill.sources.nodes import node_table

#: The tags that name a picture, where an image says its address, parts of addresses that are no picture, and sizes.
METAS = (("property", "og:image"), ("property", "og:image:secure_url"), ("name", "twitter:image"), ("name", "twitter:image:src"), ("itemprop", "image"))
SOURCES = ("data-src", "data-original", "data-lazy-src", "src")
NO_PICTURE = r"logo|icon|avatar|width=\d{1,2}&|tracker|pixel|ads|banner|social|share|button|spacer|placeholder"
BODY_CLASS = r"content|article|entry|post"
LEAST_SIDE, WIDE = 150, 600
NAMED, WIDE_SCORE, SCORE = 10.0, 3.0, 1.0


def side(value: Column) -> Column:
    """A width or height as a whole number: what remains of 100px without its unit; null if that is none."""
    digits = F.regexp_replace(value, r"[^0-9.]", "")
    return F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.floor(digits.cast("double"))).cast("int")


def bodies(nodes: DataFrame, key: str) -> DataFrame:
    """key, pre and last of the part of a page that its pictures are taken from: its first article, else its first main
    part, else the first division whose class says that it has content. Pages without any are not in it."""
    rank = (
        F.when(F.col("tag") == "article", 0).when(F.col("tag") == "main", 1)
        .when((F.col("tag") == "div") & F.exists("classes", lambda c: c.rlike(BODY_CLASS)), 2)
    )
    some = nodes.select(key, "pre", "last", rank.alias("rank")).where("rank IS NOT NULL")
    return some.groupBy(key).agg(F.min_by(F.struct("pre", "last"), F.struct("rank", "pre")).alias("b")).select(key, "b.pre", "b.last")


def page_images(pages: DataFrame, html: str, base: str, key: str) -> DataFrame:
    """key, place, url, source, score, width and height of the pictures of each page, the best first.

    Pictures of the head have the highest score, wide ones of the body a higher one than others; among equals the order of the
    page counts. Icons, small pictures and logos go; of equal addresses the first that stays is kept.
    """
    nodes = written(node_table(pages.select(key, html), html), "nodes").where(F.col("tag").isin("meta", "img", "article", "main", "div"))
    at = F.col("attributes")
    kind = F.array_compact(F.array(*[F.when(at[a] == v, F.lit(i)) for i, (a, v) in enumerate(METAS)]))
    metas = nodes.where(F.col("tag") == "meta").select(key, "pre", at["content"].alias("src"), F.explode(kind).alias("kind"))
    firsts = metas.groupBy(key, "kind").agg(F.min_by(F.struct("src"), "pre").alias("m"))
    names = F.array(*[F.lit(f"meta:{v}") for _, v in METAS])
    none = F.lit(None).cast("int")
    head = firsts.select(key, F.struct(F.lit(0).alias("part"), F.col("kind").alias("at")).alias("order"), F.col("m.src").alias("src"), F.element_at(names, F.col("kind") + 1).alias("source"), F.lit(NAMED).alias("score"), none.alias("width"), none.alias("height"))
    src = F.coalesce(*[F.when(at[a] != "", at[a]) for a in SOURCES])
    named = F.lower(F.concat_ws(" ", F.array_join("classes", " "), "node_id"))
    images = nodes.where(F.col("tag") == "img").select(key, F.col("pre").alias("at"), src.alias("src"), side(at["width"]).alias("width"), side(at["height"]).alias("height"), named.alias("named"))
    shown = images.join(bodies(nodes, key), key, "left").where(F.col("pre").isNull() | F.col("at").between(F.col("pre"), F.col("last")))
    small = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < LEAST_SIDE), F.lit(False))
    shown = shown.where(~small("width") & ~small("height") & ~F.contains("named", F.lit("logo")))
    score = F.when(F.col("width") > WIDE, WIDE_SCORE).otherwise(SCORE)
    body = shown.select(key, F.struct(F.lit(1).alias("part"), "at").alias("order"), "src", F.lit("dom").alias("source"), score.alias("score"), "width", "height")
    found = head.unionByName(body).join(pages.select(key, F.col(base).alias("_base")), key).withColumn("url", joined_url("_base", "src"))
    # addresses in the head are taken as they are
    found = found.where("url IS NOT NULL").where((F.col("order.part") == 0) | ~F.lower("url").rlike(NO_PICTURE))
    first = Window.partitionBy(key, "url").orderBy("order")
    found = found.withColumn("k", F.row_number().over(first)).where("k = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "order")) - 1
    return found.select(key, place.alias("place"), "url", "source", "score", "width", "height")
