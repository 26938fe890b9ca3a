"""Cycles over tables that change, ranked tables against sorting it all, and robots rules against the library's own answers."""

from __future__ import annotations

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from tidemill.functions import enrich
from tidemill.functions.keywords import Keywords
from tidemill.operators import paging
from tidemill.session import new_path
from tidemill.sources import robots

ROW = "id long, collected long"


def test_rows_that_move_between_pages_come_once(spark):
    """Taking a page gives its rows a later time, so they come up again on later pages."""
    state = {i: i % 7 for i in range(25)}
    current = lambda: spark.createDataFrame(sorted(state.items()), ROW)
    taken = []

    def process(fresh):
        ids = [r.id for r in fresh.collect()]
        taken.extend(ids)
        for i in ids:
            if state[i] < 100:
                state[i] += 100
        state[1000 + len(taken)] = 500  # and new ones come

    cycle = paging.paged_cycle(spark, [("all", current)], process, size=10, budget=60)
    got = [r.id for r in cycle.rows.collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(taken) and set(range(25)) <= set(got)
    assert cycle.stopped == "budget_reached" and cycle.fetched >= 60 and cycle.rows.agg(F.max("page")).first()[0] < cycle.pages


def test_budget_is_checked_before_a_page(spark):
    rows = spark.range(30).select("id", (F.col("id") % 3).alias("collected"))
    seen = []
    cycle = paging.paged_cycle(spark, [("a", lambda: rows), ("b", lambda: rows)], lambda page: seen.append(page.count()), size=8, budget=20)
    assert (cycle.pages, cycle.fetched, cycle.stopped, seen) == (3, 24, "budget_reached", [8, 8, 8])
    whole = paging.paged_cycle(spark, [("a", lambda: rows), ("b", lambda: rows)], lambda page: None, size=8)
    assert (whole.pages, whole.fetched, whole.stopped, whole.rows.count()) == (8, 60, None, 30)
    none = paging.paged_cycle(spark, [("a", lambda: rows.limit(0))], lambda page: None, size=8)
    assert (none.pages, none.rows.count(), none.stopped) == (0, 0, None)


def test_ranked_pages_against_sorting_it_all(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else rng.randrange(12) / 4) for i in range(600)]
    table = paging.RankedTable(spark, new_path(spark, "ranked")).write(spark.createDataFrame(rows, "id long, score double"), files=9)
    ranked = sorted(((s or 0.0, i) for i, s in rows), reverse=True)
    for cursor in (None, (99.0, 1), (-1.0, 5), (1.5, -1), (0.0, 40), *rng.sample(ranked, 8)):
        want = [x for x in ranked if cursor is None or x < tuple(cursor)][:11]
        got = [(r.rank_score, r.id) for r in table.page(10, cursor).orderBy(F.desc("rank_score"), F.desc("id")).collect()]
        assert got == want, cursor


def test_deep_pages_read_few_files(spark):
    table = paging.RankedTable(spark, new_path(spark, "ranked")).write(spark.range(4000).select("id", (F.col("id") / 1000).alias("score")), files=16)
    assert len(table.files_for(20, None)) <= 2 and len(table.files_for(20, (1.234, 1234))) <= 3
    plan = table.page(20, (1.234, 1234))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(rank_score,1.234)" in plan


FILES = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 5", "User-agent: *\nAllow: /a/b\nDisallow: /a", "User-agent: tide\nDisallow:\n\nUser-agent: *\nDisallow: /", "User-agent: other\nuser-agent: TIDEBOT\nDisallow: /%7Ex\nDisallow: /q?x=1",
    "Disallow: /no-agent\nUser-agent: *\n\nDisallow: /late", "# c\nUser-agent: * # all\nDisallow: /ü\nCrawl-delay: 1.5", "", "garbage\n:::\nUser-agent", "User-agent: *\nDisallow: *\nCrawl-delay: 0", "User-agent: bot\nDisallow: /\nUser-agent: x\nAllow: /",
]


def test_robots_against_the_library(spark):
    agent = "TideBot/1.0 (+http://t)"
    paths = ["", "/", "/a", "/a/b/c", "/ab", "/~x/1", "/%7Ex", "/q?x=1", "/q?x=1&y=2#f", "/ü", "/%C3%BC/1", "/late", "/no-agent"]
    urls = [(i, p, f"https://Site{i}.org{p}") for i in range(len(FILES) + 1) for p in paths]
    files = spark.createDataFrame([(f"site{i}.org", f) for i, f in enumerate(FILES)], "site string, robots string")
    rows = robots.with_robots(spark.createDataFrame(urls, "file int, path string, url string"), robots.site_rules(files, agent))
    got = {(r.file, r.path): (r.allowed, r.crawl_delay) for r in rows.collect()}
    want = {}
    for i, p, url in urls:
        parser = RobotFileParser()
        parser.parse((FILES[i] if i < len(FILES) else "").splitlines())
        delay = parser.crawl_delay(agent)
        want[i, p] = (parser.can_fetch(agent, url), None if delay is None else float(delay))
    assert got == want


@pytest.mark.parametrize(
    ("text", "utc", "minutes", "zone"),
    [
        ("Fri, 05 Jan 2024 12:00:00 EST", "2024-01-05 17:00:00", -300, "UTC-05:00"), ("5 Jul 2024 12:00 PDT", "2024-07-05 19:00:00", -420, "UTC-07:00"), ("Fri, 05 Jan 2024 12:00:00 gmt", "2024-01-05 12:00:00", 0, "UTC"),
        ("Fri, 05 Jan 2024 12:00:00 XYZ", "2024-01-05 12:00:00", 0, "XYZ"), ("Fri, 05 Jan 2024 12:00:00 m", "2024-01-06 00:00:00", -720, "UTC-12:00"), ("2024-01-05T12:00:00-03:30", "2024-01-05 15:30:00", -210, "UTC-03:30"),
    ],
)
def test_zones(spark, text, utc, minutes, zone):
    r = spark.createDataFrame([(text,)], "t string").select(enrich.parse_stamp(F.col("t")).alias("s")).select(F.date_format("s.utc", "yyyy-MM-dd HH:mm:ss"), "s.offset_minutes", "s.zone").first()
    assert tuple(r) == (utc, minutes, zone)


def test_keywords_are_found_as_substrings(spark):
    lists = (("ab", "abc", "b c"), ("c", "zz", "ab"))
    words = Keywords(*lists)
    texts = ["xabcx", "ab c", "", None, "zzz ab c b c", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("f", words.found(F.col("t")))
    got = {r.i: tuple(r)[1:] for r in rows.select("i", *[words.count(F.col("f"), x).alias(f"n{k}") for k, x in enumerate(lists)]).collect()}
    assert got == {i: tuple(sum(w in (t or "") for w in x) for x in lists) for i, t in enumerate(texts)}
