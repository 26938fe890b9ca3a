"""Feeds, pages, URLs, tags, batches and selections against plain models, on rows with odd values."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.functions import enrich
from tidemill.functions.urls import canonical, canonical_column
from tidemill.operators import dedup, ranking, scoring, selection, storing
from tidemill.sources import feeds, readers


def test_plain_urls_equal_the_exact_form(spark):
    rng = random.Random(4)
    hosts = ["www.Example.com", "m.mobile.example.org", "amp.com", "www.amp.co.uk:80", "a.b:8080", "example.com:443", "user@x.org"]
    paths = ["", "/", "/a/b", "/a//b/", "/a/../b", "/x/amp", "/x.amp", "/AMP/", "/ä", "/a%20b", "/p;q=1", "/a.b/c"]
    queries = ["", "?", "?a=1&B=2&a=1", "?utm_source=x&ref=y", "?b=2&a=", "?a=b=c", "?q=x+y", "?ICID1=2&z=9", "#top", "?a=1#f?b"]
    urls = [f"{rng.choice(['http://', 'https://', 'HTTPS://', ''])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(queries)}" for _ in range(400)]
    urls += [None, "", " ", "mailto:a@b.c", "https://", " https://example.com/a ", "tel:12", "//cdn.example.com/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r.i: r.url for r in df.select("i", canonical_column(F.col("url")).alias("url")).collect()}
    assert {i: got[i] for i in got if got[i] != canonical(urls[i])} == {}


def test_feeds_with_broken_parts(spark):
    rss = """<rss><channel><title>T &amp; U</title><item><title><![CDATA[First <b>one</b>]]></title><link>http://www.e.com/1?utm_source=a</link>
      <description>&lt;p&gt;A long enough text &amp;amp; more&lt;/p&gt;</description><author>  B   b </author><category>x</category><enclosure type="image/png" url="http://e.com/i.png"/>
      <guid>doi:10.1234/abc.5</guid><pubDate>Fri, 5 Jan 2024 10:00:00 +0100</pubDate></item>
      <item><title>no link here</title></item><item><title>abc</title><link>http://e.com/short</link></item>
      <item><link>http://e.com/2</link><title>Second</title></item><item><title>cut off"""
    atom = """<feed><title>At</title><entry><title>Atom entry</title><link rel="enclosure" type="image/jpeg" href="http://e.com/p.jpg"/><link href="http://e.com/3"/><id>e3</id>
      <updated>2024-01-05T10:00:00Z</updated><author><name>C c</name></author><summary>short</summary><content>long enough content</content></entry></feed>"""
    df = spark.createDataFrame([("a", rss), ("b", atom), ("c", "no feed"), ("d", None)], "name string, feed string")
    got = {(r.name, r.place): r for r in feeds.feed_items(df).collect()}
    assert set(got) == {("a", 0), ("a", 3), ("b", 0)}
    first, entry = got["a", 0], got["b", 0]
    assert first.title == "First <b>one</b>" and first.url == "https://www.e.com/1".replace("www.", "") and first.feed_title == "T & U"
    assert first.summary == "A long enough text & more".replace("& more", "&amp; more") and first.authors == ["B b"] and first.image_url == "http://e.com/i.png"
    assert first.doi == "10.1234/abc.5" and first.tags == ["x"]
    assert entry.original_url == "http://e.com/3" and entry.image_url == "http://e.com/p.jpg" and entry.authors == ["C c"] and entry.summary == "long enough content"
    assert feeds.feed_items(df, most=1).count() == 2


def test_replay_feed_reads_back(spark):
    df = spark.createDataFrame([("s", [("T <1> & 2", "http://e.com/1", "some summary", ["A", "B"], ["t"], "2024-01-05T10:00:00Z")])], "source string, articles array<struct<title:string,link:string,summary:string,authors:array<string>,tags:array<string>,published:string>>")
    text = df.select("source", feeds.render_feed(F.lit("F"), F.lit("u"), F.col("source"), F.col("articles")).alias("feed"))
    r = feeds.feed_items(text).first()
    assert (r.title, r.original_url, r.summary, r.authors, r.tags, r.stamp) == ("T <1> & 2", "http://e.com/1", "some summary", ["A, B"], ["t"], "2024-01-05T10:00:00Z")


def test_listed_articles(spark):
    ld = '<script type="application/ld+json">{"@type":"Blog","blogPost":[{"headline":"H","url":"/x"},{"name":"N","url":"http://o.com/y","datePublished":"d"},{"name":"none"}]}</script>'
    broken = '<script type="application/ld+json">{"@type":"ItemList", oops</script>'
    boxes = "<article><h2>Head <i>one</i></h2><a class='c' href='/one'>text</a></article><article><a href=\"two\">Only link</a></article><article><h2>No link</h2></article>"
    df = spark.createDataFrame([(1, ld + boxes), (2, broken + boxes), (3, None)], "id int, html string")
    got = feeds.listed_articles(df.withColumn("base", F.lit("https://e.com/blog/")), "html", "base", "id").orderBy("id", "place").collect()
    assert [(r.id, r.title, r.url) for r in got] == [(1, "H", "https://e.com/x"), (1, "N", "http://o.com/y"), (2, "Headone", "https://e.com/one"), (2, "Only link", "https://e.com/blog/two")]


def test_stamps(spark):
    given = {
        "Fri, 05 Jan 2024 12:00:00 +0200": ("2024-01-05 10:00:00", 120, "UTC+02:00"), "2024-01-05T12:00:00.25-03:30": ("2024-01-05 15:30:00", -210, "UTC-03:30"),
        "6 Jan 2024 7:05": ("2024-01-06 07:05:00", 0, "UTC"), "2024-13-01": None, "31 Foo 2024 10:00": None, "": None, "2024-01-05": ("2024-01-05 00:00:00", 0, "UTC"),
    }
    df = spark.createDataFrame([(k,) for k in [*given, None]], "t string").select("t", enrich.parse_stamp(F.col("t")).alias("s"))
    got = {r.t: r.s and (r.utc, r.s.offset_minutes, r.s.zone) for r in df.withColumn("utc", F.date_format("s.utc", "yyyy-MM-dd HH:mm:ss")).collect()}
    assert got == {**given, None: None}


def test_tags_against_a_model(spark):
    stop, spelling, alias, short = ("noticias",), {"quimica": "química"}, {"space x": "spacex"}, ("ai",)
    fold = lambda t: t.translate(str.maketrans("áéíóúñü", "aeiounu"))

    def model(tags):
        clean, removed, replaced, merged, out = [], [], [], [], {}
        for t in tags:
            s = re.sub(r"\s+", " ", re.sub("[-_]", " ", t.strip().lower()).replace(".", ""))
            if not s or s in stop:
                removed.append(s or t)
                continue
            for names in (spelling, alias):
                if names.get(s, s) != s:
                    replaced.append(f"{s}>{names[s]}")
                    s = names[s]
            clean.append(s)
        for t in clean:
            old = out.setdefault(fold(t), t)
            if old != t:
                merged.append(f"{old}>{t}")
        fit = [t for t in out.values() if (len(t) >= 3 or t in short) and len(t) <= 40]
        removed += [t for t in out.values() if t not in fit]
        return fit[:8], removed, replaced, merged

    rng = random.Random(2)
    words = ["Energía_Oscura", "energia oscura", "A.I.", "x", "noticias", "SPACE-X", "", " clima  global ", "l" * 41, "ciencia", "quimica", "Química", "bio", "geo", "astro", "uno", "dos"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 14))]) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, tags array<string>").select("i", enrich.sanitize_tags(F.col("tags"), stop, spelling, alias, short).alias("r"))
    got = {r.i: (r.r.tags, r.r.removed, r.r.replaced, r.r.merged) for r in df.collect()}
    assert {i: got[i] for i, t in rows if got[i] != model(t)} == {}


def test_chunks_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, rng.choice([1, 5, 30, 120])) for i in range(300)]
    got = {(r.g, r.i): r.chunk for r in selection.chunks(spark.createDataFrame(rows, "g int, i int, size int").repartition(5), "g", "i", "size", 6, 100).collect()}
    for g in range(4):
        chunk, items, total = 0, 0, 0
        for _, i, s in sorted(r for r in rows if r[0] == g):
            if items and (items >= 6 or total + s > 100):
                chunk, items, total = chunk + 1, 0, 0
            items, total = items + 1, total + s
            assert got[g, i] == chunk


@pytest.mark.parametrize("first", [8, 1024])
def test_capped_list_against_a_loop(spark, first):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.9, 0.8, 0.5]), rng.choice(["2024", "2023", None]), rng.choice(["a", "b", "c", None]), rng.choice([[], ["x"], ["x", "y"], ["z"], None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, score double, published string, source string, topics array<string>")
    ties = {r.id: r.tie for r in df.select("id", F.xxhash64("id", F.lit(7)).alias("tie")).collect()}
    for k, sc, tc in ((10, 0.3, 0.4), (40, 0.5, 0.2), (5, 0.0, 0.0)):
        sources, topics, want = Counter(), Counter(), []
        for i, score, day, source, tags in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "unknown", ties[r[0]]), reverse=True):
            source, tags = source or "unknown", set(tags or [])
            if len(want) == k or sources[source] >= max(1, int(k * sc)) or any(topics[t] >= max(1, int(k * tc)) for t in tags):
                continue
            want.append(i)
            sources[source] += 1
            topics.update(tags)
        got = ranking.capped(df, k, sc, tc, seed=7, first=first).orderBy("place").collect()
        assert [r.id for r in got] == want and [r.place for r in got] == list(range(1, len(want) + 1))


def test_first_in_batch_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["u1", "u2", "u3", "u4", "u5", None]), rng.choice(["d1", "d2", "d3", "d4", "d5"])) for i in range(60)] + [(100 + i, f"c{i // 2}", f"e{(i + 1) // 2}") for i in range(20)]
    urls, digests, want = set(), set(), []
    for i, u, d in sorted(rows):
        if u not in urls and d not in digests:
            urls.add(u)
            digests.add(d)
            want.append(i)
    df = spark.createDataFrame(rows, "id long, u string, d string").repartition(4)
    assert sorted(r.id for r in dedup.first_in_batch(df, "u", "d", "id").collect()) == want
    assert dedup.first_in_batch(df.limit(0), "u", "d", "id").count() == 0


def test_persisted_scores(spark):
    articles = spark.createDataFrame([(1, 0.1, "a"), (2, None, "b")], "id long, score double, name string")
    log = spark.createDataFrame([(1, 0.1)], "id long, score double")
    updated, whole = scoring.persist_scores(articles, log, spark.createDataFrame([(2, 0.7)], "id long, score double"), "id", ["score"])
    assert sorted((r.id, r.score, r.name) for r in updated.collect()) == [(1, 0.1, "a"), (2, 0.7, "b")] and whole.count() == 2
    assert [scoring.scorer_of(m) for m in ("basic", "cognitive", None, "x")] == ["basic", "cognitive", "feature", "feature"]


def test_catalogue_and_addresses(spark, tmp_path):
    (tmp_path / "sources.yaml").write_text("a:\n  name: A\n  _group: AI_LABS\n  credibility_score: 0.9\nb:\n  name: B\n")
    rows = feeds.read_catalogue(spark, str(tmp_path / "sources.yaml"))
    assert {r.source_id: (r.name, r.etag) for r in rows.collect()} == {"a": ("A", None), "b": ("B", None)}
    assert [(r.source_id, r.bucket) for r in feeds.group_buckets(rows).collect()] == [("a", "AI_LABS")]
    assert readers.database_url({"path": "/x.db"}) == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        readers.database_url({"type": "oracle"})


def test_leaders_against_a_loop(spark):
    rng = random.Random(8)
    pairs = {(a, b): rng.randint(0, 10) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(110))}
    leader = {}
    for i in range(60):
        near = sorted((d, a) for (a, b), d in pairs.items() if b == i and leader[a] == a)
        leader[i] = near[0][1] if near else i
    nodes, edges = spark.range(60), spark.createDataFrame([(a, b, d) for (a, b), d in pairs.items()], "id long, other long, distance int")
    assert {r.id: r.leader for r in storing.leaders(nodes, edges).collect()} == leader
    assert storing.leaders(nodes.limit(0), edges.limit(0)).count() == 0


def test_leaders_of_equal_hashes_against_a_loop(spark):
    """A copy may follow a leader that came after the first of its class."""
    rng = random.Random(2)
    base = rng.getrandbits(63)
    near = lambda n: base ^ sum(1 << k for k in rng.sample(range(48), n))
    some = [near(rng.randint(0, 9)) for _ in range(25)]
    rows = [(i, rng.choice(some)) for i in range(120)] + [(200, 0)]
    led, want = [], {}
    for i, h in rows[:-1]:
        d, leader = min(((h ^ g).bit_count(), k) for k, g in led) if led else (99, 0)
        want[i] = leader if d <= 10 else i
        if d > 10:
            led.append((i, h))
    assert {r.id: r.leader for r in storing.leader_clusters(spark.createDataFrame(rows, "id long, simhash long")).collect()} == want
