"""Sources as a dimension: selection, crawl delays, upserts, strategies, state changes and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fetch strategies and the counters that they feed.
BUCKETS = {"http": "http", "scrapling_http": "http", "headless": "headless", "headless_fallback": "headless", "scrapling_stealth": "headless", "proxy": "proxy", "scholarly": "scholarly"}
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"


def strategy_bucket(strategy: Column) -> Column:
    """The counter of a strategy, null if it is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair]), F.lower(F.trim(strategy)))


def processable(manual_only: Column, blacklisted: Column) -> Column:
    return ~F.coalesce(manual_only, F.lit(False)) & ~F.coalesce(blacklisted, F.lit(False))


def source_filter(category=None, credibility: float | None = None, frequency: str | None = None, tier: int | None = None) -> Column:
    """Sources of a category, of at least a credibility, of an update frequency, of a tier: all that are given."""
    found = F.lit(True)
    for name, value in (("category", category), ("update_frequency", frequency), ("tier", tier)):
        found = found & F.coalesce(F.col(name) == value, F.lit(False)) if value is not None else found
    return found & (F.coalesce("credibility_score", F.lit(0.0)) >= credibility) if credibility is not None else found


def effective_delay(base: Column, *others: Column) -> Column:
    """The longest of the delays that are known."""
    return F.greatest(base, *[F.coalesce(o, F.lit(0.0)) for o in others])


def safe_url(url: Column) -> Column:
    """Whether a URL is http or https and its host no private or local address, as far as its text tells."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:?#]+)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.)") | host.rlike(r"\.(local|internal)$")
    return (host != "") & ~private


def upsert(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the fresh values of columns where there are any, and rows that are new."""
    a, b = stored.alias("a"), fresh.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])


def backoff(failures: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), failures))


def lockable(headless: Column, http: Column, attempts: Column) -> Column:
    return (headless >= 70) & (http <= 10) & (attempts >= 5)


def success_rate(failed_in_a_row: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - failed_in_a_row / total))


def identity_date(published: Column, collected: Column) -> Column:
    """The day of publication, else of collection, else null: such rows are quarantined, never dated today."""
    return F.coalesce(F.to_date(published), F.to_date(collected))


def category_key(name: Column) -> Column:
    from tidemill.functions.text import fold_accents

    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(F.trim(name))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def unique_slugs(df: DataFrame, slug: str, order: str) -> DataFrame:
    """The first row of each slug keeps it; later ones are refused."""
    w = Window.partitionBy(slug).orderBy(order)
    return df.withColumn("taken", F.row_number().over(w) == 1)


def pages_until(df: DataFrame, order: list[Column], size: int, budget: int, scale: int = 4096) -> DataFrame:
    """Whole pages of rows in order until the budget is met; the order is cut to that many rows before it is numbered."""
    pages = -(-budget // size)
    first = df.orderBy(*order).limit(pages * size)
    return first.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def transition(status: Column, wanted: str, allowed: tuple[str, ...]) -> Column:
    """The status after a change that only some states allow."""
    return F.when(status.isin(*allowed), wanted).otherwise(status)


def retained(df: DataFrame, old: Column, score: Column, least: float = 0.3) -> DataFrame:
    """Rows that a cleanup keeps: recent ones, good ones, and those without a score."""
    return df.where(~(old & F.coalesce(score < least, F.lit(False))))
