"""Robots rules as data: the rule groups of each site's file, and for every address whether an agent may fetch it and how slowly.

A file is read once, with the rules of the standard library, into one row a site: the rules of the group that counts for
the agent, in their order, and its crawl delay. Addresses meet that row by their site; the first rule that starts their path
decides. A site's rules are bounded by its file, so a site with a third of all addresses makes no more rows than it has
addresses, and its join can be split.

Defined results: a site without a file, or with one that has no group for the agent, allows everything and has no delay; an
address that cannot be read is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RULES = "delay double, rules array<struct<allow:boolean,path:string>>"
EVERYTHING = "*"


def group_for(text: str, agent: str) -> tuple[float | None, list[dict]]:
    """The crawl delay and the rules of a robots file that count for an agent."""
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    groups = [e for e in parser.entries if e.applies_to(agent)] or ([parser.default_entry] if parser.default_entry else [])
    if not groups:
        return None, []
    delay = groups[0].delay
    return None if delay is None else float(delay), [{"allow": r.allowance, "path": r.path} for r in groups[0].rulelines]


def site_rules(files: DataFrame, agent: str, site: str = "site", text: str = "robots") -> DataFrame:
    """site, delay and rules of each robots file, for one agent."""

    @F.pandas_udf(f"struct<{RULES.replace(' double', ':double').replace('rules array', 'rules:array')}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [group_for(t, agent) for t in texts]
            yield pd.DataFrame({"delay": pd.Series([d for d, _ in made], dtype="Float64"), "rules": [r for _, r in made]})

    return files.select(F.col(site), read(F.coalesce(F.col(text), F.lit(""))).alias("r")).select(site, "r.delay", "r.rules")


@F.pandas_udf(StringType())
def robots_path(urls: pd.Series) -> pd.Series:
    """The path by which rules know an address: path, query and fragment, quoted one way."""

    def path(url: str) -> str | None:
        try:
            u = urlparse(unquote(url))
            return quote(urlunparse(("", "", u.path, u.params, u.query, u.fragment))) or "/"
        except ValueError:
            return None

    return urls.map(path, na_action="ignore")


def site_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1))


def with_robots(requests: DataFrame, rules: DataFrame, url: str = "url", site: str = "site") -> DataFrame:
    """requests with allowed and crawl_delay."""
    asked = requests.withColumn("_site", site_of(F.col(url))).withColumn("_path", robots_path(F.col(url)))
    joined = asked.join(rules.select(F.col(site).alias("_of"), F.col("delay").alias("crawl_delay"), F.col("rules").alias("_rules")), F.col("_site") == F.col("_of"), "left")
    first = F.get(F.filter("_rules", lambda r: (r["path"] == EVERYTHING) | F.startswith(F.col("_path"), r["path"])), F.lit(0))
    return joined.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_site", "_path", "_of", "_rules")
