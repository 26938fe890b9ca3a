"""Readers and writers at the borders: feeds, replay lines, monitoring files, logs, front matter, rejects, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPLAY = (
    "source_id string, url string, feed_title string, category string, credibility_score double, latency_ms double, status_code int, etag string, "
    "last_modified string, content_hash string, articles array<struct<link:string,title:string,summary:string,authors:array<string>,tags:array<string>,published:string,doi:string>>"
)
MONITORING = (
    "window struct<start:string,end:string>, baselines map<string,struct<expected_articles_per_window:double,max_gap_hours:double,"
    "language_distribution:map<string,double>,topic_distribution:map<string,double>>>, source_windows array<struct<source_id:string,window_start:string,"
    "window_end:string,articles_found:int,expected_count:int,last_article_at:string,consecutive_failures:int,schema_violations:int,"
    "languages:map<string,int>,topics:map<string,int>>>"
)
RSS_ITEM = "title string, link string, description string, pubDate string, guid string, category string, author string"
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+)\s* \| ([^|]+?) \| (.*)$"
MOST_ENTRIES, LEAST_TITLE = 500, 5


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files with a link and a title, at most MOST_ENTRIES of each file; broken items are skipped."""
    items = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(RSS_ITEM).load(path)
    items = items.withColumn("feed", F.input_file_name()).where((F.length("title") >= LEAST_TITLE) & F.col("link").isNotNull())
    w = Window.partitionBy("feed").orderBy(F.monotonically_increasing_id())
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MOST_ENTRIES)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLAY).json(path)


def replay_articles(replay: DataFrame) -> DataFrame:
    return replay.select("source_id", "category", F.posexplode("articles").alias("place", "a")).select("source_id", "category", "place", "a.*")


def read_monitoring(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(windows, baselines) of a monitoring file."""
    whole = spark.read.schema(MONITORING).option("multiLine", True).json(path)
    windows = whole.select(F.explode("source_windows").alias("w")).select("w.*")
    baselines = whole.select(F.explode("baselines").alias("source_id", "b")).select("source_id", "b.*")
    return windows, baselines


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """time, level, place and message of log lines; other lines drop out."""
    lines = spark.read.text(path)
    parts = [F.regexp_extract("value", LOG_LINE, i).alias(n) for i, n in enumerate(("time", "level", "place", "message"), 1)]
    return lines.where(F.col("value").rlike(LOG_LINE)).select(*parts)


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """path, front (a map) and body of Markdown files."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.regexp_extract_all(front, F.lit(r"(?m)^(\w+):[ ]*(.*)$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+):", 1).alias("k"), F.trim(F.regexp_replace(p, r"^\w+:", "")).alias("v")))
    return whole.select("path", F.map_from_entries(entries).alias("front"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def reject_key(source: str, url: str, time: str):
    return F.substring(F.sha2(F.concat_ws("|", source, url, F.col(time).cast("string")), 256), 1, 12)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("append").json(path)


def write_export(articles: DataFrame, path: str, version: str = "2.0") -> None:
    articles.select(F.struct(F.lit(version).alias("version"), F.struct(*articles.columns).alias("article")).alias("e")).select("e.*").write.mode("overwrite").json(path)


def database_url(config: dict) -> str:
    """The JDBC address of a configured SQLite or PostgreSQL database, for spark.read.jdbc."""
    if config.get("type", "sqlite") == "sqlite":
        return f"jdbc:sqlite:{config.get('path', '')}"
    if config["type"] != "postgresql":
        raise ValueError(f"unknown database type {config['type']!r}")
    port = f":{config['port']}" if config.get("port") else ""
    return f"jdbc:postgresql://{config.get('host', 'localhost')}{port}/{config.get('name', '')}"


def schema_issues(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """column, expected, found of each column that is missing or has another type, and of each that is not expected."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, expected.get(c), found.get(c)) for c in sorted({*expected, *found}) if expected.get(c) != found.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string")


def write_health(records: DataFrame, path: str) -> None:
    """Health records of sources as JSON lines, one document for each source."""
    records.write.mode("overwrite").json(path)


def read_only_view(df: DataFrame, name: str) -> DataFrame:
    """A view over a snapshot: queries see the files as they are, and nothing writes through it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
