"""The formats of the data source API: ranges that cut lines, logs that grow, posts that are written whole or not at all."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.session import new_path
from tidemill.sources import formats


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def line(i, level="INFO"):
    return f"2024-01-05 12:00:{i % 60:02d} | {level}  | src.mod:{i} | message {i} ü\n"


def test_ranges_give_each_line_once(tmp_path):
    rng = random.Random(1)
    text = "".join(rng.choice(["", "x" * rng.randint(0, 40), "ü" * 5]) + "\n" for _ in range(60)) + "last without an end"
    path = tmp_path / "a.log"
    path.write_text(text)
    size = path.stat().st_size
    want, at = [], 0
    for x in text.encode().split(b"\n"):
        want.append((at, x.decode()))
        at += len(x) + 1
    for split in (1, 2, 7, 64, size, size + 9):
        got = [r for part in formats.ranges([(str(path), 0, size)], split) for r in formats.lines_of(str(tmp_path), part)]
        assert got == [w for w in want if w[0] < size], split


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(line(i) for i in range(50)) + "no log line\n" + line(50, "ERROR").rstrip("\n"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/b.log").write_text(line(7))
    (tmp_path / "c.txt").write_text(line(8))
    (tmp_path / ".hidden.log").write_text(line(9))
    for split in (40, 1 << 20):
        rows = spark.read.format("tidemill_log").option("split", split).load(str(tmp_path)).collect()
        assert sorted(int(r.place.split(":")[1]) for r in rows) == sorted([*range(51), 7])
    assert {r.level for r in rows} == {"INFO", "ERROR"} and max(r.message for r in rows).endswith("ü")
    assert spark.read.format("tidemill_log").load(str(tmp_path / "none")).count() == 0


def test_a_growing_log_is_followed(spark, tmp_path):
    log, out, place = tmp_path / "app.log", new_path(spark, "log-out"), new_path(spark, "log-offsets")

    def follow():
        stream = spark.readStream.format("tidemill_log").option("split", 100).load(str(tmp_path))
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
        run.awaitTermination(120)
        run.stop()
        return sorted(int(r.place.split(":")[1]) for r in spark.read.parquet(out).collect())

    log.write_text(line(0) + line(1) + line(2)[:20])
    assert follow() == [0, 1]  # the third line is not whole yet
    with log.open("a") as f:
        f.write(line(2)[20:] + line(3))
    (tmp_path / "new.log").write_text(line(10))
    assert follow() == [0, 1, 2, 3, 10]
    assert follow() == [0, 1, 2, 3, 10]
    log.write_text(line(20))  # rotated: shorter than what was read
    assert follow() == [0, 1, 2, 3, 10, 20]


def test_replay_lines(spark, tmp_path):
    rows = [{"source_id": f"s{i % 3}", "status_code": 200, "articles": [{"link": f"u{i}", "title": "t", "extra": 1}]} for i in range(20)]
    text = "\n".join(json.dumps(r) for r in rows) + "\n\n{broken\n[1]\n"
    (tmp_path / "replay.jsonl").write_text(text)
    found = spark.read.format("tidemill_replay").option("split", 50).load(str(tmp_path)).orderBy("at").collect()
    assert [r.articles[0].link for r in found if r.error is None] == [f"u{i}" for i in range(20)]
    assert [r.error for r in found if r.error] == ["JSONDecodeError", "AttributeError"]


def posts(spark, names, body="text\n---\nmore"):
    return spark.createDataFrame([(n, {"title": f"T: {n}", "permalink": f"/p/{n}/"}, body) for n in names], "name string, front map<string,string>, body string").repartition(2)


def test_posts_read_back(spark, tmp_path):
    path = str(tmp_path / "posts")
    posts(spark, ["a", "b", "c"]).write.format("tidemill_posts").mode("append").save(path)
    rows = spark.read.format("tidemill_posts").option("site", "https://e.com/").load(path).orderBy("path").collect()
    assert [(r.front["title"], r.body, r.published_url) for r in rows] == [(f"T: {n}", "text\n---\nmore", f"https://e.com/p/{n}/") for n in "abc"]
    posts(spark, ["d"], "Fuente original: [https://src.org/x] end").write.format("tidemill_posts").mode("overwrite").save(path)
    (row,) = spark.read.format("tidemill_posts").load(path).collect()
    assert row.source_url == "https://src.org/x" and row.published_url is None
    assert not [p for p in (tmp_path / "posts").iterdir() if p.name.startswith(".stage")]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "posts")
    posts(spark, ["kept"]).write.format("tidemill_posts").mode("append").save(path)
    bad = posts(spark, ["x", "y"]).unionByName(posts(spark, ["../out"]))
    with pytest.raises(Exception, match="not a name of a post"):
        bad.write.format("tidemill_posts").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "posts").iterdir()) == ["kept.md"]


@pytest.mark.parametrize(
    ("text", "source"),
    [("---\nsource: 'u1'\noriginal_url: u2\n---\nb", "u1"), ("---\nsource:\noriginal_url: u2\n---\nb", "u2"), ("no front\nfuente ORIGINAL: https://x.org/a b", "https://x.org/a"), ("---\ntitle: t", None), ("", None)],
)
def test_sources_of_posts(text, source):
    assert formats.source_of(*formats.front_of(text)) == source
