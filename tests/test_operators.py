"""Operators that SQL does not express, against independent models; readers, sinks and streams on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import html
from tidemill.functions.urls import canonical
from tidemill.operators import dedup, editorial, explain, folds, monitoring, validation
from tidemill.sources import readers


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.Example.com:80/a//b/../c/?utm_source=x&b=2&a=1#top", "https://example.com/a/c/?a=1&b=2"),
        ("https://example.com/story/amp", "https://example.com/story/"),
        ("https://example.com/story.amp", "https://example.com/story/"),
        ("example.com/story/AMP/", "https://example.com/story/"),
        ("//example.com/foo", "https://example.com/foo"),
        ("example.com:80", "https://example.com/"),
        ("localhost:8080/x", "https://localhost:8080/x"),
        ("https://user:Key@Example.com:443/x;a=1", "https://user:key@example.com/x"),
        ("https://e.com/a%20b?q=a+b&k=&A=%26", "https://e.com/a%20b?a=%26&q=a%20b"),
        ("/foo", "/foo"),
        ("m.example.org/?ref=1", "https://example.org/"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(url, want):
    assert canonical(url) == want


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"(https?://)?(www\.|m\.)?[a-z]{2,6}\.(org|com)(/[a-z]{0,4}){0,3}(\?[a-c]=[0-9]{0,2}(&[a-c]=[0-9]{1,2}){0,2})?", fullmatch=True))
def test_canonical_is_stable(url):
    once = canonical(url)
    assert canonical(once) == once
    assert once.startswith("https://")


def test_first_in_batch_is_greedy(spark):
    """The second row is dropped and claims nothing, so the third stays."""
    df = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3"), (4, "u9", "h9")], "n long, url string, digest string")
    assert sorted(r.n for r in dedup.first_in_batch(df, "url", "digest", "n").collect()) == [1, 3, 4]


def test_clusters(spark):
    nodes = spark.range(12)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (8, 9)], "id long, other long")
    got = {r.id: r.label for r in dedup.clusters(nodes, pairs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}


def test_simhash_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a")], "id long, text string")
    got = {r.id: r.simhash for r in dedup.simhash(df, "id", F.col("text")).collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] != 0


def greedy(rows, k, source_cap, topic_cap):
    out, sources, topics = [], {}, {}
    for score, key, source, topic in sorted(rows, key=lambda r: (-r[0], -r[1])):
        if len(out) == k:
            break
        if sources.get(source, 0) >= max(1, int(k * source_cap)) or topics.get(topic, 0) >= max(1, int(k * topic_cap)):
            continue
        sources[source] = sources.get(source, 0) + 1
        topics[topic] = topics.get(topic, 0) + 1
        out.append(key)
    return out


def test_fold_matches_a_plain_loop(spark):
    start = dt.datetime(2024, 1, 1)
    kinds = ["click", "purchase", "error", "error", "error", "view", "purchase"]
    rows = [(i, start + dt.timedelta(minutes=i), i % 3, kinds[(i * 5) % 7], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    want = {}
    for _, _, user, kind, value in rows:
        want.setdefault(user, folds.SourceState()).apply(kind, value)
    got = {r.user_id: r for r in folds.fold_events(df).collect()}
    for user, state in want.items():
        assert (got[user].attempts, got[user].failures, got[user].times_opened) == (state.attempts, state.failures, state.times_opened)
        assert got[user].mean == pytest.approx(state.mean)


def test_empty_fold(spark):
    df = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert folds.fold_events(df).count() == 0


def test_rule_chain(spark):
    body = "study results " * 40
    rows = [(1, "A study of results", body), (2, "A study of results", "short"), (3, "Best deals study results", body), (4, "Unrelated heading words", body)]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    got = {r.id: r.reason for r in df.select("id", validation.first_reason(F.col("title"), F.col("content"), F.lit(False)).alias("reason")).collect()}
    assert got == {1: None, 2: "too_few_words", 3: "blocked_title", 4: "title_not_in_body"}


def test_suppressions_and_canaries(spark):
    alerts = spark.createDataFrame([("a", "critical", 1.0, 0), ("a", "critical", 2.0, 0), ("b", "ok", 50.0, 0), ("c", "ok", 1.0, 1)], "source string, severity string, idle_h double, failures int")
    assert sorted(r.source for r in monitoring.suppressions(alerts, "source").collect()) == ["a", "b"]
    windows = spark.createDataFrame([(1, 0, 1.0), (2, 9, 99.0), (3, 9, 1.0)], "id int, found int, idle double")
    got = {r.id: r.canary for r in monitoring.canaries(windows, 5, F.col("idle"), 48).collect()}
    assert got == {1: "too_few", 2: "idle", 3: "pass"}


def test_readers(spark, tmp_path):
    rss = tmp_path / "feed.xml"
    rss.write_text("<rss><channel><item><title>A long title</title><link>http://x.org/a</link></item><item><title>No</title><link>http://x.org/b</link></item></channel></rss>")
    assert [r.link for r in readers.read_rss(spark, str(rss)).collect()] == ["http://x.org/a"]
    lines = tmp_path / "replay.jsonl"
    lines.write_text(json.dumps({"source_id": "s", "category": "c", "articles": [{"link": "l1", "title": "t"}, {"link": "l2"}]}) + "\n")
    assert [r.link for r in readers.replay_articles(readers.read_replay(spark, str(lines))).orderBy("place").collect()] == ["l1", "l2"]
    log = tmp_path / "x.log"
    log.write_text("2024-01-01 00:00:00 | INFO     | a:1 | hello | world\nnoise\n")
    assert [(r.level, r.place, r.message) for r in readers.read_log(spark, str(log)).collect()] == [("INFO", "a:1", "hello | world")]
    post = tmp_path / "post.md"
    post.write_text("---\ntitle: Hi\nslug: hi-there\n---\nBody\n")
    got = readers.read_front_matter(spark, str(post)).collect()[0]
    assert got.front == {"title": "Hi", "slug": "hi-there"} and got.body == "Body\n"
    watch = tmp_path / "m.json"
    watch.write_text(json.dumps({"baselines": {"s": {"expected_articles_per_window": 4.0}}, "source_windows": [{"source_id": "s", "articles_found": 1}]}))
    windows, baselines = readers.read_monitoring(spark, str(watch))
    assert windows.count() == 1 and baselines.collect()[0].source_id == "s"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "t")], "id long, title string")
    readers.write_export(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0].article.title == "t"
    readers.write_rejects(df, str(tmp_path / "rejects"))
    readers.write_rejects(df, str(tmp_path / "rejects"))
    assert spark.read.json(str(tmp_path / "rejects")).count() == 2


def test_html():
    page = "<html><head><style>x</style></head><body><nav>Menu</nav><p>Caf&eacute; &amp; tea</p><p>Read more</p><script>1</script><p>End</p></body></html>"
    assert html.text_of(page) == "Menu Café & tea End"
    assert html.text_of(page, html.FRAME) == "Café & tea End"
    assert html.text_of("Continue reading…") == ""
    assert html.normal_text("ﬁne&nbsp;\x00 \r\n text") == "fine text"


def test_explanations(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], None, {"x": 0.5}), ([], None, {"source_credibility": 0.5, "recency": 0.75}), (None, None, None)], "s array<string>, f array<string>, c map<string,double>")
    got = [r.w for r in df.select(explain.why_ranked(F.col("s"), F.col("f"), F.col("c")).alias("w")).collect()]
    assert got == [["a", "b", "c"], ["Recency score 0.75", "Source Credibility score 0.50"], ["Ranked by overall score"]]


def test_source_report(spark):
    rows = [("2024-01-01 00:00:00", "source=a found=9 saved=9"), ("2024-01-02 00:00:00", "Cycle started"), ("2024-01-02 00:01:00", "source=a found=5 saved=3 failed=1"), ("2024-01-02 00:02:00", "source=a found=2 saved=0")]
    got = explain.source_report(spark.createDataFrame(rows, "time string, message string")).collect()
    assert [(r.source_id, r.found, r.saved, r.failed, r.publishable) for r in got] == [("a", 7, 3, 1, 2)]


def test_audit_and_outliers(spark):
    sources = spark.createDataFrame([("a", "", 0.5, "rss", True, "full"), ("b", "u", 2.0, "headless", False, "full"), ("c", "u", 0.5, "rss", True, "full")], "id string, url string, credibility_score double, strategy string, headless_enabled boolean, content_mode string")
    assert {r.id: r.issues for r in explain.audit_sources(sources).collect()} == {"a": ["missing_url"], "b": ["credibility_out_of_range", "headless_disabled"]}
    members = spark.createDataFrame([("k", 1, 0), ("k", 2, 3), ("k", 3, -1)], "cluster string, id long, h long")
    assert [r.id for r in explain.outliers_of_clusters(members, "cluster", "id", "h").collect()] == [3]


def test_percentiles_of_large_and_constant_groups(spark):
    from tidemill.operators import analytics

    rows = spark.range(30_000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    rows = rows.union(spark.range(500).select(F.lit("b"), F.lit(2.0))).union(spark.createDataFrame([("c", 1.0), ("c", 2.0), (None, 5.0)], "k string, v double"))
    got = {r.k: r for r in analytics.percentiles(rows, "k", "v", accuracy=1000).collect()}
    want = {r.k: r for r in rows.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.99)).alias("p99")).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].p50, got[k].p99) == (pytest.approx(r.p50), pytest.approx(r.p99))


# ---- editorial review


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"picks": [1, 2]}', "[1,2]"),
        ("[3, 4]", "[3,4]"),
        ('Sure:\n```json\n{"picks": [5]}\n```', "[5]"),
        ('I took {"note": "a } in text", "picks": [6]} and left', "[6]"),
        ("these: [7, 8].", "[7,8]"),
        ('{"picks": "none"}', "[]"),
        ('{"other": [1]}', "[]"),
        ("nothing", "[]"),
        ("{broken [9]", "[9]"),
        ("", "[]"),
        (None, "[]"),
    ],
)
def test_salvage(reply, want):
    assert editorial.salvage(reply, "picks") == want


def test_rolling_means(spark):
    rows = [(k, i, v) for k in ("a", "b") for i, v in enumerate([1.0, 2.00005, None, 3.3333, 0.1])] + [(None, 0, 1.0)]
    got = {r.k: (r.n, r.mean) for r in editorial.rolling_means(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    want = 0.0
    for n, v in enumerate([1.0, 2.00005, 0.0, 3.3333, 0.1], 1):
        want = round(want + (v - want) / n, 4)
    assert got == {"a": (5, want), "b": (5, want)}


def test_council_without_scores_or_answer(spark):
    answers = spark.createDataFrame([(1, "Sí"), (2, "si, claro"), (3, None), (4, "sin duda"), (5, "No")], "k int, said string")
    scores = spark.createDataFrame([(k, s) for k in (1, 3, 4, 5) for s in (5.0, 4.0)], "k int, s double")
    got = {r.k: (r.average, r.approved) for r in editorial.council_verdicts(answers, scores, "k", "said", "s").collect()}
    assert got == {1: (4.5, True), 2: (0.0, False), 3: (4.5, False), 4: (4.5, False), 5: (4.5, False)}
