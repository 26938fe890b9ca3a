"""Text of HTML, Unicode normalization, tags and entities: what Spark's built-in functions cannot say, in Arrow batches."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements without text of their own, frames around page text, and phrases of feeds.
HIDDEN = frozenset({"script", "style", "noscript"})
FRAME = HIDDEN | {"nav", "footer", "header", "aside", "iframe", "svg"}
BOILERPLATE = re.compile(r"(?i)^\s*(read more|continue reading|the post .* appeared first on .*?)[\s.…]*$", re.DOTALL)


class _Text(HTMLParser):
    def __init__(self, skipped: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.depth, self.parts = skipped, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skipped

    def handle_endtag(self, tag):
        if tag in self.skipped and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip() and not BOILERPLATE.match(data):
            self.parts.append(data.strip())


def text_of(markup: str, skipped: frozenset[str] = HIDDEN) -> str:
    """The text chunks of HTML outside skipped elements, boilerplate chunks left out; tags are stripped if parsing fails."""
    try:
        parser = _Text(skipped)
        parser.feed(markup)
        parser.close()
        text = " ".join(parser.parts)
    except (AssertionError, ValueError):
        text = re.sub(r"<[^>]*>", " ", markup)
    text = re.sub(r"\s+", " ", text).strip()
    return "" if BOILERPLATE.match(text) else text


def normal_text(text: str) -> str:
    """Entities resolved, NFKC, no NUL, white space collapsed."""
    text = unicodedata.normalize("NFKC", entities.unescape(text)).replace("\0", "")
    return re.sub(r"\s+", " ", text).strip()


def closed_references(column: Column, names: str = "#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*") -> Column:
    """Markup in which only entities of these names, with their semicolon, are entities: any other ampersand is text.

    HTML resolves old names without it too, so a reference that was cut off may or may not be one; this makes it none.
    """
    return F.regexp_replace(column, f"&(?!({names});)", "&amp;")


def _map(column: Column, f) -> Column:
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore")

    return run(column)


def clean_html(column: Column) -> Column:
    return _map(column, text_of)


def page_text(column: Column) -> Column:
    return _map(column, lambda m: text_of(m, FRAME))


def normalize_text(column: Column) -> Column:
    return _map(column, normal_text)


def normalized_html(column: Column) -> Column:
    """The text of HTML, normalized."""
    return _map(column, lambda m: normal_text(text_of(m)))
