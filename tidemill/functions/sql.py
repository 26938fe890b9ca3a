"""The library's functions in SQL text: register(spark), then SELECT canonical_url(url), ... or FROM feed_items(TABLE(feeds))."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemill.functions import html
from tidemill.functions.feed_xml import FeedReader
from tidemill.functions.urls import canonicalize_url

MOST_ENTRIES = 500
ITEMS = "source string, place int, title string, link string, summary string, stamp string, error string"


@F.pandas_udf(StringType())
def clean_html(markup: pd.Series) -> pd.Series:
    return markup.map(html.text_of, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    return text.map(html.normal_text, na_action="ignore")


class FeedItems:
    """The items of each row (source, feed) of a table, as the pull parser finds them; the error is the feed's."""

    def eval(self, row: Row) -> Iterator[tuple]:
        reader = FeedReader(row["feed"] or "")
        for place, item in enumerate(list(reader.items(MOST_ENTRIES))):
            summary = item.text("summary", "description", "content:encoded", "content")
            yield row["source"], place, item.text("title"), item.link(), summary, item.text("pubDate", "published", "updated", "dc:date"), reader.error


def register(spark: SparkSession) -> None:
    """canonical_url, clean_html and normalize_text of a string, and the table function feed_items."""
    spark.udf.register("canonical_url", canonicalize_url)
    spark.udf.register("clean_html", clean_html)
    spark.udf.register("normalize_text", normalize_text)
    spark.udtf.register("feed_items", F.udtf(FeedItems, returnType=ITEMS))
