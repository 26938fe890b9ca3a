"""A pull parser for feeds that keeps reading after errors and says what the first of them was.

One pass over a document's tokens with a stack of open elements. An end tag that does not match closes what it can, a stray sign
is text, an entity that XML does not know is read as HTML's, and an item that the document's end cuts off is left out; the class of the
first such error is remembered. Prefixes are resolved through the declarations in scope, so a feed may name its
namespaces as it likes; an undeclared prefix is an error of its own and is read as the usual one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

#: The namespaces of feeds and the prefix by which fields are called here.
NAMESPACES = {
    "http://www.w3.org/2005/Atom": "", "http://purl.org/rss/1.0/": "", "http://backend.userland.com/rss2": "",
    "http://purl.org/dc/elements/1.1/": "dc", "http://purl.org/rss/1.0/modules/content/": "content", "http://search.yahoo.com/mrss/": "media",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf", "http://www.w3.org/1999/xhtml": "xhtml", "http://www.w3.org/XML/1998/namespace": "xml",
}
ROOTS, ITEMS = ("rss", "feed", "RDF"), ("item", "entry")
NOT_WELL_FORMED, UNDECLARED, NOT_XML = "SAXParseException", "UndeclaredNamespace", "NonXMLContent"
TOKEN = re.compile(
    r"""<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!(?!\[|--)[^<>\[]*+(?:\[[^\]]*+\][^<>\[]*+)?>
    |<(?P<end>/?)(?P<name>[A-Za-z_][\w.:-]*+)(?P<inside>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|(?P<text>[^<]++)|(?P<stray><)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*)\s*=\s*("[^"]*"|'[^']*')""")
#: Elements that are nested deeper count as text of the one above them.
MOST_DEPTH = 100
ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)")


class Element(NamedTuple):
    """An element of an item: its attributes and what stands in it, markup of inner elements included."""

    attributes: dict[str, str]
    text: str


class Item:
    """The elements of an item by name, in order. Those inside an author or a group count as the item's, too."""

    def __init__(self) -> None:
        self.fields: dict[str, list[Element]] = {}

    def all(self, *names: str) -> list[Element]:
        return [e for n in names for e in self.fields.get(n, [])]

    def text(self, *names: str) -> str | None:
        return next((e.text.strip() for e in self.all(*names) if e.text.strip()), None)

    def link(self) -> str | None:
        """The text of a link, or the address of the first one that is the article's, else of any but an image's."""
        links = [e.attributes for e in self.all("link") if e.attributes.get("href") and not e.attributes.get("type", "").startswith("image/")]
        own = [a for a in links if a.get("rel", "alternate") == "alternate"]
        guid = next((e.text.strip() for e in self.all("guid") if e.attributes.get("isPermaLink") == "true"), None)
        return self.text("link") or next((a["href"] for a in [*own, *links]), None) or guid

    def image(self) -> str | None:
        shown = [e.attributes.get("url") for e in self.all("media:content") if e.attributes.get("medium") == "image"]
        shown += [e.attributes.get("url") for e in self.all("enclosure") if e.attributes.get("type", "").startswith("image/")]
        shown += [e.attributes.get("url") for e in self.all("media:thumbnail")]
        shown += [e.attributes.get("href") for e in self.all("link") if e.attributes.get("type", "").startswith("image/")]
        return next((u for u in shown if u), None)


class FeedReader:
    """Reads one document: `items` yields what it has, `error` and `title` are known when they have been read."""

    def __init__(self, text: str) -> None:
        self.source = text
        self.error: str | None = None
        self.title: str | None = None
        self.rooted = False
        self.open: list[tuple[str, str, dict[str, str], list[str]]] = []
        self.below = 0
        self.scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]

    def wrong(self, kind: str) -> None:
        self.error = self.error or kind

    def named(self, raw: str) -> str:
        """A name with the prefix by which it is known here."""
        prefix, _, local = raw.rpartition(":")
        uri = self.scopes[-1].get(prefix)
        if uri is None:
            if prefix and prefix != "xmlns":
                self.wrong(UNDECLARED)
            known = prefix
        else:
            known = NAMESPACES.get(uri, prefix)
        return f"{known}:{local}" if known else local

    def unescaped(self, text: str) -> str:
        if "&" not in text:
            return text
        if ENTITY.search(text):
            self.wrong(NOT_WELL_FORMED)
        return html.unescape(text)

    def add(self, text: str) -> None:
        for _, _, _, parts in self.open[-1:]:
            parts.append(text)

    def started(self, raw: str, inside: str) -> tuple[str, dict[str, str]]:
        pairs = [(k, self.unescaped(v[1:-1])) for k, v in ATTRIBUTE.findall(inside)]
        declared = {k.partition(":")[2]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        self.scopes.append(self.scopes[-1] | declared if declared else self.scopes[-1])
        for k, _ in pairs:
            if ":" in k and not k.startswith("xmlns"):
                self.named(k)
        return self.named(raw), dict(pairs)

    def items(self, most: int, whole: bool = False) -> Iterator[Item]:
        """The first `most` items, as they end. With `whole`, what follows them is read too, for errors only."""
        item, found = None, 0
        for m in TOKEN.finditer(self.source):
            kind = m.lastgroup
            if kind == "cdata":
                if not m[0].endswith("]]>"):
                    self.wrong(NOT_WELL_FORMED)
                self.add(m["cdata"])
            elif kind in ("text", "stray"):
                if kind == "stray" or (not self.open and m["text"].strip("﻿ \t\r\n")):
                    self.wrong(NOT_WELL_FORMED)
                self.add(self.unescaped(m[kind]))
            elif m["name"] is None:
                if m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<?") and not m[0].endswith("?>"):
                    self.wrong(NOT_WELL_FORMED)
            elif self.below or (len(self.open) >= MOST_DEPTH and not m["end"]):
                self.below += -1 if m["end"] else not m["inside"].endswith("/")
                self.add(m[0])
            elif not m["end"]:
                name, attributes = self.started(m["name"], m["inside"])
                self.rooted = self.rooted or name.rpartition(":")[2] in ROOTS
                self.open.append((m["name"], name, attributes, []))
                if name in ITEMS and item is None and found < most:
                    item = Item()
                if m["inside"].endswith("/"):
                    yield from self.closed(item)
                    item = None if name in ITEMS else item
            else:
                names = [o[0] for o in self.open]
                if m["name"] not in names:
                    self.wrong(NOT_WELL_FORMED)
                    continue
                while True:
                    raw, name = self.open[-1][:2]
                    yield from self.closed(item)
                    if name in ITEMS:
                        item = None
                        found += 1
                    if raw == m["name"]:
                        break
                    self.wrong(NOT_WELL_FORMED)
                if found >= most and not whole:
                    return
        if self.open:
            self.wrong(NOT_WELL_FORMED)
        if not self.rooted:
            self.error = NOT_XML

    def closed(self, item: Item | None) -> Iterator[Item]:
        """The innermost element ends: it becomes a field of the item, the feed's title, or the item that is yielded."""
        raw, name, attributes, parts = self.open.pop()
        self.scopes.pop()
        text = "".join(parts)
        if name in ITEMS:
            if item is not None:
                yield item
        elif item is not None:
            item.fields.setdefault(name, []).append(Element(attributes, text))
            self.add(f"<{raw}>{text}</{raw}>")
        elif name == "title" and self.title is None and self.open and self.open[-1][1] in ("channel", "feed"):
            self.title = text.strip() or None
