"""Feeds that are broken in many ways, pages as tables of nodes, and selectors against a walk over the same nodes."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions.feed_xml import NOT_WELL_FORMED, NOT_XML, UNDECLARED, FeedReader
from tidemill.sources import feeds, images, nodes

# ---- feeds


def read(text, most=500):
    reader = FeedReader(text)
    found = [(i.text("title"), i.link()) for i in reader.items(most)]
    return found, reader.error, reader.title


ITEM = "<item><title>One</title><link>http://e.com/1</link></item>"


@pytest.mark.parametrize(
    ("text", "items", "error"),
    [
        (f"<?xml version='1.0'?><rss><channel><title>F</title>{ITEM}</channel></rss>", 1, None),
        (f"\ufeff<!DOCTYPE rss [<!ENTITY x 'y'>]><rss><channel>{ITEM}<!-- <item> --></channel></rss>", 1, None),
        (f"<rss><channel>{ITEM}{ITEM}<item><title>cut", 2, NOT_WELL_FORMED),
        (f"<rss><channel>{ITEM}<item><title>a & b</title><link>u</link></item></channel></rss>", 2, NOT_WELL_FORMED),
        (f"<rss><channel>{ITEM}<item><title>a &nbsp; b</title><link>u</link></item></channel></rss>", 2, NOT_WELL_FORMED),
        (f"<rss><channel>{ITEM}<item><title>a < b</title><link>u</link></item></channel></rss>", 2, NOT_WELL_FORMED),
        (f"<rss><channel><b>{ITEM}</channel></rss>", 1, NOT_WELL_FORMED),
        (f"<rss><channel>{ITEM}</wrong></channel></rss>", 1, NOT_WELL_FORMED),
        (f"<rss><channel>{ITEM}<item><x:y>n</x:y><link>u</link></item></channel></rss>", 2, UNDECLARED),
        (f"<rss xmlns:x='http://x.org'><channel>{ITEM}<item><x:y x:z='1'>n</x:y></item></channel></rss>", 2, None),
        (f"<rss><channel xmlns:x='http://x.org'></channel><x:y/>{ITEM}</rss>", 1, UNDECLARED),
        ("<html><body><p>no feed</p></body></html>", 0, NOT_XML),
        ("plain text", 0, NOT_XML),
        ("", 0, NOT_XML),
        ("<feed><entry/><entry></entry></feed>", 2, None),
    ],
)
def test_errors_have_a_class_and_cost_little(text, items, error):
    found, seen, _ = read(text)
    assert (len(found), seen) == (items, error)


def test_namespaces_by_address():
    text = """<a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:m="http://search.yahoo.com/mrss/" xmlns:d="http://purl.org/dc/elements/1.1/"><a:title>T</a:title>
      <a:entry><a:title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">A <b>b</b></div></a:title><a:link rel="self" href="http://e.com/self"/><a:link rel="alternate" href="http://e.com/1?a=1&amp;b=2"/>
      <d:creator>C</d:creator><m:content medium="image" url="http://e.com/i.png"/></a:entry></a:feed>"""
    reader = FeedReader(text)
    (item,) = reader.items(9)
    assert item.link() == "http://e.com/1?a=1&b=2" and item.text("dc:creator") == "C" and item.image() == "http://e.com/i.png"
    assert item.text("title") == "<div>A <b>b</b></div>" and reader.title == "T" and reader.error is None


def test_only_the_first_items_are_read():
    text = "<rss><channel>" + ITEM * 2000
    assert len(read(text, 500)[0]) == 500 and read(text, 500)[1] is None


def test_reading_takes_linear_time():
    for text in ("<" * 200_000, "<a b='" * 50_000, "<![CDATA[" * 30_000, "&" * 300_000, "<rss>" + "<a>" * 30_000, "<rss><item>" + "<a>x</a>" * 30_000, "<rss><item>" + "<a>x" * 30_000 + "</a></b>" * 30_000, "<!--" * 50_000, "<!D [" * 50_000):
        began = time.time()
        read(text)
        assert time.time() - began < 10, text[:20]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<rss>", "</rss>", "<item>", "</item>", "<title>", "</title>", "<link href='u'/>", "<x:y a='1'>", "</x:y>", "&amp;", "&", "<", ">", "text", "<![CDATA[", "]]>", "<!--", "-->", "'"]), max_size=40))
def test_anything_is_read(parts):
    found, error, _ = read("".join(parts))
    assert len(found) <= parts.count("<item>") and error in (None, NOT_WELL_FORMED, UNDECLARED, NOT_XML)


def test_errors_of_feeds(spark):
    df = spark.createDataFrame([("good", f"<rss><channel><title>F</title>{ITEM}</channel></rss>"), ("cut", f"<rss><channel>{ITEM}<item>"), ("page", "<p>x</p>"), ("none", None)], "name string, feed string")
    got = {r.name: (r.n_items, r.feed_title, r.error, r.accepted) for r in feeds.feed_errors(df).collect()}
    assert got == {"good": (1, "F", None, True), "cut": (1, None, NOT_WELL_FORMED, True), "page": (0, None, NOT_XML, False), "none": (0, None, NOT_XML, False)}


# ---- nodes and selectors

PAGE = """<html><body id=top><div class="news-item  big"><a href="/news/1"><h3>Article 1</h3></a><div class="news-item"><p>in <b>it</b><br>x</p></div></div>
<ul><li data-k="a b"><a rel=next href="/2">two</a><li><span></span></ul></wrong><p lang=en>end<img src=i.png></body></html>"""


def walk(rows):
    """The element above each node, and whether a part of a selector fits."""
    return {r[0]: r for r in rows}


def fits(row, part):
    pre, last, parent, tag, id_, classes, attributes, _ = row
    at = dict(attributes)
    tests = {"=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": str.startswith, "$=": str.endswith, "*=": lambda a, v: v in a}
    return (
        tag != nodes.TEXT and part.tag in (None, tag) and all(x == id_ for x in part.ids) and all(c in classes for c in part.classes)
        and all(n in at and (not op or tests[op](at[n], v)) for n, op, v in part.attributes)
    )


def chosen(rows, selector):
    by = walk(rows)

    def holds(pre, chain):
        if not fits(by[pre], chain[-1]):
            return False
        if len(chain) == 1:
            return True
        up = by[pre][2]
        while up is not None:
            if holds(up, chain[:-1]):
                return True
            up = None if chain[-1].child else by[up][2]
        return False

    return sorted(r[0] for r in rows if any(holds(r[0], c) for c in nodes.compiled(selector)))


SELECTORS = ["a", "*", "div", "div.news-item", ".news-item .news-item p", "div > a > h3", "div > h3", "body a, li", "#top > ul > li", "li li", "[data-k]", "li[data-k~=b]", "a[href^='/n']", "img[src$=png]", "a[rel=next][href*=2]", "p[lang='en'], p", "ul > * > a"]


def test_selectors_against_a_walk(spark):
    rng = random.Random(3)
    pieces = ["<div class='news-item'>", "<div>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "<p>", "</p>", "<a href='/n/1'>", "</a>", "t", "<h3>", "</h3>", "<img src=a.png>", "<br>"]
    pages = [PAGE, "", "text only", *("".join(rng.choices(pieces, k=40)) for _ in range(12))]
    table = nodes.node_table(spark.createDataFrame(list(enumerate(pages)), "page int, html string"), "html").cache()
    for selector in SELECTORS:
        got = {}
        for r in nodes.selected(table, selector, "page").select("page", "pre").collect():
            got.setdefault(r.page, []).append(r.pre)
        want = {i: chosen(nodes.parsed(p), selector) for i, p in enumerate(pages)}
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}, selector


def test_places_of_nodes_nest():
    rows = nodes.parsed(PAGE)
    for pre, last, parent, *_ in rows:
        assert pre <= last and (parent is None or (parent < pre and last <= rows[parent][1]))


def test_unknown_selectors_are_refused():
    for bad in ("", "> a", "a:hover", "a + b", "a,,b", "[x"):
        with pytest.raises(ValueError):
            nodes.compiled(bad)


def test_listed_articles_by_selectors(spark):
    page = '<div class="news-item"><a href="/news/1"><h3>Article 1</h3></a></div><div class="news-item"><a href="news/2"><h3>Article 2</h3></a></div>'
    nested = '<section><h2>Out</h2><section><a href="//o.com/in"><h2></h2>In <i>side</i></a></section></section>'
    cards = "<a class=card href='/c/1'><h2>Card</h2></a><a class=card><h2>No address</h2></a>"
    df = spark.createDataFrame([(1, page), (2, nested), (3, cards), (4, None)], "id int, html string").withColumn("base", F.lit("https://e.com/blog/index.html"))
    of = lambda n, *how: [(r.title, r.url) for r in feeds.listed_articles(df.where(F.col("id") == n), "html", "base", "id", *how).orderBy("place").collect()]
    assert of(1, "div.news-item", "a", "h3") == [("Article 1", "https://e.com/news/1"), ("Article 2", "https://e.com/blog/news/2")]
    assert of(2, "section") == [("Out", "https://o.com/in"), ("Inside", "https://o.com/in")]
    assert of(3, "a.card", "self") == [("Card", "https://e.com/c/1")]
    assert of(4) == []


def test_images(spark):
    pages = {
        1: '<head><meta name="twitter:image" content="t.png"><meta property="og:image" content=""><meta property="og:image" content="late.png"><meta itemprop=image content="http://o.com/ads.png"></head><img src=a.jpg>',
        2: '<img src=out.jpg><div class="x my-content"><img src=in.jpg width=700><img src=in.jpg width=100><img src="b.jpg" width="100%"></div>',
        3: '<div class=post><img src=p.jpg></div><main><img src=m.jpg height=149></main>',
        4: '<article></article><main><img src=m.jpg></main>',
        5: '<article><img src=a.jpg width=10><img src=a.jpg width=200.7px><img src=a.jpg width=900><img src="../../up.jpg" width=..><img id=Logo src=l.jpg><img src=" "><img></article>',
        6: "",
    }
    df = spark.createDataFrame(list(pages.items()), "id int, html string").withColumn("base", F.lit("https://e.com/x/y.html"))
    got = {}
    for r in images.page_images(df, "html", "base", "id").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.url, r.source, r.score, r.width))
    assert got == {
        1: [("https://e.com/x/t.png", "meta:twitter:image", 10.0, None), ("http://o.com/ads.png", "meta:image", 10.0, None), ("https://e.com/x/a.jpg", "dom", 1.0, None)],
        2: [("https://e.com/x/in.jpg", "dom", 3.0, 700)],
        5: [("https://e.com/x/a.jpg", "dom", 1.0, 200), ("https://e.com/up.jpg", "dom", 1.0, None), ("https://e.com/x/y.html", "dom", 1.0, None)],
    }
