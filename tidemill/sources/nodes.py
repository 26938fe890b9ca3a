"""HTML pages as tables of nodes, and CSS selectors as joins over them.

Each element of a page is a row with its place in document order (pre), the place of the last node inside it (last), its parent,
tag, id, classes and attributes; each text is a row with the tag `#text`. An element is inside another if its place lies between
pre and last of that one, so a descendant is a join by page with a range of places, and a child one with an equal parent.

Selectors have tags, `*`, `.class`, `#id`, `[name]`, `[name=value]` and the operators `=`, `~=`, `^=`, `$=`, `*=`, joined by
descendant (space) and child (`>`), with alternatives after commas. As in browsers, what stands before the last part may lie
outside the element that is searched.

Pages are parsed row by row, since no built-in reads HTML; an end tag closes the innermost element of its name, and what
has no such element is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that have no content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
TEXT = "#text"
NODE = "pre int, last int, parent int, tag string, node_id string, classes array<string>, attributes map<string,string>, content string"
ARROW = pa.schema([
    ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("node_id", pa.string()), ("classes", pa.list_(pa.string())),
    ("attributes", pa.map_(pa.string(), pa.string())), ("content", pa.string()),
])


class NodeReader(HTMLParser):
    """Collects the nodes of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def add(self, tag: str, attributes: dict[str, str] | None = None, content: str | None = None) -> None:
        at = attributes or {}
        self.rows.append([len(self.rows), len(self.rows), self.open[-1] if self.open else None, tag, at.get("id"), at.get("class", "").split(), list(at.items()), content])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.add(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[i][3] == tag for i in self.open):
            while self.end_innermost() != tag:
                pass

    def end_all(self) -> None:
        while self.open:
            self.end_innermost()

    def end_innermost(self) -> str | None:
        if not self.open:
            return None
        i = self.open.pop()
        self.rows[i][1] = len(self.rows) - 1
        return self.rows[i][3]

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.add(TEXT, content=data)


def parsed(page: str | None) -> list[list]:
    reader = NodeReader()
    reader.feed(page or "")
    reader.close()
    reader.end_all()
    return reader.rows


def node_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages but html, once for each node, with NODE."""
    rest = [f for f in pages.schema if f.name != html]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(html)):
                rows = parsed(page.as_py())
                if rows:
                    given = [pa.concat_arrays([batch.column(c).slice(i, 1)] * len(rows)) for c in names]
                    made = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)]
                    yield pa.RecordBatch.from_arrays([*given, *made], names=[*names, *ARROW.names])

    return pages.select(*names, html).mapInArrow(run, T.StructType([*rest, *T.StructType.fromDDL(NODE).fields]))


# ---- selectors

PART = re.compile(r"""\s*(?P<join>>)?\s*(?P<compound>(?:[\w*-]+|\.[\w-]+|\#[\w-]+|\[[^\]]*\])+)""")
PIECE = re.compile(r"""(?P<tag>^[\w*-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")
TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, v: a == v, "~=": lambda a, v: F.array_contains(F.split(a, r"\s+"), v), "^=": F.startswith, "$=": F.endswith, "*=": F.contains,
}


@dataclass
class Compound:
    """One part of a selector: what an element itself must be, and how it stands to the part before it."""

    child: bool = False
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str | None, str]] = field(default_factory=list)

    def test(self) -> Column:
        tests = [F.col("tag") == self.tag if self.tag else F.col("tag") != TEXT]
        tests += [F.coalesce(F.col("node_id") == x, F.lit(False)) for x in self.ids]
        tests += [F.array_contains("classes", x) for x in self.classes]
        for name, op, value in self.attributes:
            has = F.col("attributes")[name]
            tests.append(F.coalesce(TESTS[op](has, F.lit(value)), F.lit(False)) if op else has.isNotNull())
        return reduce(Column.__and__, tests)


def compiled(selector: str) -> list[list[Compound]]:
    """The alternatives of a selector, each a chain of parts."""
    chains = []
    for choice in re.split(r",(?![^\[]*\])", selector):
        chain, at = [], 0
        choice = choice.strip()
        while at < len(choice):
            m = PART.match(choice, at)
            if not m or (m["join"] and not chain):
                raise ValueError(f"not a selector that is understood: {selector!r}")
            part = Compound(child=bool(m["join"]))
            whole, seen = m["compound"], 0
            for p in PIECE.finditer(whole):
                seen += len(p[0])
                if p["tag"]:
                    part.tag = None if p["tag"] == "*" else p["tag"].lower()
                elif p["cls"]:
                    part.classes.append(p["cls"])
                elif p["id"]:
                    part.ids.append(p["id"])
                else:
                    part.attributes.append((p["name"].lower(), p["op"], (p["value"] or "").strip("\"'")))
            if seen != len(whole):
                raise ValueError(f"not a selector that is understood: {selector!r}")
            chain.append(part)
            at = m.end()
        if not chain:
            raise ValueError(f"not a selector that is understood: {selector!r}")
        chains.append(chain)
    return chains


def selected(nodes: DataFrame, selector: str, key: str) -> DataFrame:
    """The rows of nodes whose elements match the selector, each once."""

    def chain_of(chain: list[Compound]) -> DataFrame:
        found = nodes.where(chain[0].test())
        for part in chain[1:]:
            above = found.select(F.col(key).alias("_page"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))
            below = nodes.where(part.test())
            near = F.col("parent") == F.col("_pre") if part.child else (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_last"))
            found = below.join(above, (F.col(key) == F.col("_page")) & near, "left_semi")
        return found

    chains = [chain_of(c) for c in compiled(selector)]
    return chains[0] if len(chains) == 1 else reduce(DataFrame.unionByName, chains).dropDuplicates([key, "pre"])


def first_inside(boxes: DataFrame, nodes: DataFrame, selector: str, key: str) -> DataFrame:
    """key, box and the struct `found` of the first element inside each box (key, pre, last) that matches, by the place of the box."""
    inner = selected(nodes, selector, key).select(F.col(key).alias("_page"), F.struct("pre", "last", "attributes").alias("_node"))
    own = boxes.select(key, F.col("pre").alias("box"), F.col("last").alias("_last"))
    inside = (F.col(key) == F.col("_page")) & (F.col("_node.pre") > F.col("box")) & (F.col("_node.pre") <= F.col("_last"))
    return own.join(inner, inside).groupBy(key, "box").agg(F.min_by("_node", F.col("_node.pre")).alias("found"))


def texts_inside(elements: DataFrame, nodes: DataFrame, key: str, by: str = "pre") -> DataFrame:
    """key, `by` and text: the stripped texts inside each element (key, by, pre, last), joined as they stand."""
    pieces = nodes.where(F.col("tag") == TEXT).select(F.col(key).alias("_page"), F.col("pre").alias("_pre"), F.trim(F.regexp_replace("content", r"\s+", " ")).alias("_text"))
    own = elements.select(key, F.col(by).alias("_by"), F.col("pre").alias("_first"), "last")
    inside = (F.col(key) == F.col("_page")) & (F.col("_pre") > F.col("_first")) & (F.col("_pre") <= F.col("last"))
    rows = own.join(pieces, inside).groupBy(key, "_by").agg(F.sort_array(F.collect_list(F.struct("_pre", "_text"))).alias("t"))
    return rows.select(key, F.col("_by").alias(by), F.array_join(F.transform("t", lambda x: x["_text"]), "").alias("text"))
