"""Queries of sources, feeds, index pages, posts, files and enrichment, with their SQL.

Raw documents (feeds, posts, pages) are made of the driver's tables; queries of file sources write them to the shared
folder and read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import enrich as E
from tidemill.functions import sql
from tidemill.functions import topics as W
from tidemill.operators import catalogue
from tidemill.plans.bindings import events, table
from tidemill.plans.registry import ACCENTS_SQL, SPACES, query, sql_text
from tidemill.session import new_path
from tidemill.sources import feeds, formats, images, readers, robots

# ---- feeds


def _articles_of(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    title = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"\s+", " "))
    return docs.select(
        "doc_id", F.col("source").alias("feed"), title.alias("title"), F.concat(F.lit("http://www.example.com/"), F.col("doc_id").cast("string"), F.lit("?utm_source=x")).alias("link"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("<p>summary & more of "), F.col("doc_id").cast("string"), F.lit("</p>"))).otherwise("short").alias("summary"),
        F.array(F.lit("B Author"), F.lit("A Author")).alias("authors"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("tag"), F.lit("Guest Author"))).alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, "Fri, 05 Jan 2024 12:00:00 +0200").when(F.col("doc_id") % 3 == 1, "2024-01-05T12:00:00Z").alias("published"),
    )


def _feeds(spark, d) -> DataFrame:
    """One RSS document for each source, its first articles in the order of their ids: no more than are read of a feed."""
    item = F.struct("title", "link", "summary", "authors", "tags", "published")
    first = Window.partitionBy("feed").orderBy("doc_id")
    rows = _articles_of(spark, d).withColumn("k", F.row_number().over(first)).where(F.col("k") <= readers.MOST_ENTRIES)
    per = rows.groupBy("feed").agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("a")))).alias("rows"))
    made = F.transform("rows", lambda r: r["a"])
    return per.select("feed", feeds.render_feed(F.concat(F.lit("Feed "), F.col("feed")), F.lit("http://example.com/"), F.col("feed"), made).alias("text"))


FEED = r"""given AS (SELECT doc_id, source AS feed, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents WHERE text IS NOT NULL),
items AS (SELECT *, trim(title) AS clean FROM given WHERE place < 500)"""


@query(f"""WITH {FEED} SELECT feed, CAST(place AS INTEGER) AS place, CASE WHEN clean = '' THEN 'Sin título' ELSE clean END AS title, 'https://example.com/' || doc_id AS url, 'Feed ' || feed AS feed_title FROM items WHERE length(clean) >= 5 OR clean = ''""")
def s3_feed_items(spark, d):
    found = feeds.feed_items(_feeds(spark, d).where("feed IS NOT NULL"), "text")
    return found.select("feed", "place", "title", "url", "feed_title")


@query("""WITH n AS (SELECT source AS feed, least(count(*), 500) AS n, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 5 AS kind FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1)
  SELECT feed, CASE kind WHEN 4 THEN 0 ELSE n END AS n_items, CASE kind WHEN 1 THEN 'SAXParseException' WHEN 2 THEN 'UndeclaredNamespace' WHEN 3 THEN 'SAXParseException' WHEN 4 THEN 'NonXMLContent' END AS error, kind <> 4 AS accepted FROM n""")
def s4_broken_feeds(spark, d):
    """Feeds as they are, with tags that are closed wrongly, with a prefix that is not declared, cut off at the end, and texts that are no feeds."""
    kind, text = F.regexp_extract("feed", "[0-9]+", 0).cast("int") % 5, F.col("text")
    broken = (
        F.when(kind == 1, F.replace(text, F.lit("</title>"), F.lit("</b></title>"))).when(kind == 2, F.replace(text, F.lit("<item>"), F.lit("<item><x:note>n</x:note>")))
        .when(kind == 3, F.replace(text, F.lit("</channel></rss>"), F.lit(""))).when(kind == 4, feeds.strip_tags(text)).otherwise(text)
    )
    rows = _feeds(spark, d).where("feed IS NOT NULL").select("feed", broken.alias("text"))
    return feeds.feed_errors(rows, "text").select("feed", "n_items", "error", "accepted")


@query(f"""WITH {FEED} SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'summary & more of ' || doc_id ELSE '' END AS summary, CASE WHEN doc_id % 2 = 0 THEN 'B Author, A Author|Guest Author' ELSE 'B Author, A Author' END AS authors,
  CASE WHEN doc_id % 2 = 0 THEN 'tag|Guest Author' ELSE '' END AS tags, 'http://www.example.com/' || doc_id || '?utm_source=x' AS entry_id FROM items WHERE (length(clean) >= 5 OR clean = '') AND feed IS NOT NULL""")
def f12_feed_fields(spark, d):
    found = feeds.feed_items(_feeds(spark, d).where("feed IS NOT NULL"), "text")
    key = F.regexp_extract("original_url", r"/(\d+)\?", 1).cast("long")
    return found.select(key.alias("doc_id"), "summary", F.array_join("authors", "|").alias("authors"), F.array_join("tags", "|").alias("tags"), "entry_id")


@query("""WITH q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn FROM events), asked AS (SELECT user_id, t AS turn FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0 UNION ALL SELECT -1), (SELECT unnest(range(0, 40)) AS t))
  SELECT a.user_id, CAST(a.turn AS INTEGER) AS turn, q.event_id AS answer, CASE WHEN a.user_id = -1 THEN 'unknown_source' WHEN q.event_id IS NULL THEN 'exhausted' ELSE 'ok' END AS state FROM asked a LEFT JOIN q ON a.user_id = q.user_id AND a.turn = q.turn""")
def s11_replay_queue(spark, d):
    queue = feeds.replay_queue(table(spark, d, "events").select("user_id", F.col("event_id").alias("answer")), "user_id", "answer")
    asked = table(spark, d, "events").where("user_id % 3 = 0").select("user_id").distinct().union(spark.range(1).select(F.lit(-1).cast("long")))
    requests = asked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return feeds.answered(requests, queue, "user_id")


@query(f"WITH {FEED} SELECT feed AS source, CAST(place AS INTEGER) AS place, nullif(clean, '') AS title, 'http://www.example.com/' || doc_id || '?utm_source=x' AS link FROM items WHERE feed IS NOT NULL")
def s3_feed_function(spark, d):
    """Items of feeds by a table function, in SQL text."""
    sql.register(spark)
    _feeds(spark, d).where("feed IS NOT NULL").select(F.col("feed").alias("source"), F.col("text").alias("feed")).createOrReplaceTempView("landed_feeds")
    return spark.sql("SELECT source, place, title, link FROM feed_items(TABLE(landed_feeds))")


# ---- index pages and posts


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, page_id % 2 = 0 AS listed, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    regexp_extract_all(html, '(?s)<li>.*?</li>') AS boxes FROM pages),
  boxes AS (SELECT page_id, root, unnest(boxes) AS box, generate_subscripts(boxes, 1) - 1 AS place FROM p WHERE NOT listed),
  found AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(regexp_extract(box, '(?s)(<a [^>]*>.*?</a>)', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title, root || regexp_extract(box, 'href="([^"]*)"', 1) AS url FROM boxes)
  SELECT page_id, CAST(place AS INTEGER) AS place, title, url FROM found WHERE title <> ''
  UNION ALL SELECT page_id, 0, 'Headline ' || page_id, root || '/story/' || page_id FROM p WHERE listed""".replace("\\\\s", "\\s"))
def s6_index_pages(spark, d):
    pages = table(spark, d, "pages")
    entry = F.to_json(F.struct(F.concat(F.lit("Headline "), F.col("page_id").cast("string")).alias("headline"), F.concat(F.lit("/story/"), F.col("page_id").cast("string")).alias("url")))
    script = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), entry, F.lit(',{"name":"no address"}]}</script>'))
    html = F.when(F.col("page_id") % 2 == 0, F.concat(script, "html")).otherwise(F.col("html"))
    found = feeds.listed_articles(pages.select("page_id", html.alias("html"), F.regexp_extract("url", r"^(https?://[^?#]+)", 1).alias("url_of_page")), "html", "url_of_page", "page_id", "li", "a", "h2")
    return found.select("page_id", "place", "title", "url")


@query(r"""WITH p AS (SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS title, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN '[removed]' ELSE trim(text) END AS body, role FROM conversations)
  SELECT conv_id, turn, title, 'https://www.reddit.com/r/x/' || conv_id || '/' || turn AS url, CASE WHEN turn % 2 = 0 THEN 'https://example.com/' || conv_id END AS original_url,
    CASE WHEN body IN ('', '[removed]') THEN title ELSE title || chr(10) || chr(10) || body END AS summary, CASE WHEN turn % 5 = 0 THEN '' ELSE role END AS authors FROM p WHERE length(title) >= 10""")
def s7_community_posts(spark, d):
    turn = F.col("turn")
    link = F.concat_ws("/", F.lit("/r/x"), F.col("conv_id").cast("string"), turn.cast("string"))
    body = F.when(turn % 3 == 0, F.lit(None).cast("string")).when(turn % 3 == 1, "[removed]").otherwise(F.col("text"))
    post = F.to_json(F.struct(
        F.substring_index("text", "\n", 1).alias("title"), link.alias("permalink"), F.when(turn % 2 == 0, F.concat(F.lit("https://example.com/"), F.col("conv_id").cast("string"))).alias("url"),
        body.alias("selftext"), F.lit(1704456000.0).alias("created_utc"), F.when(turn % 5 == 0, "[deleted]").otherwise(F.col("role")).alias("author"), F.lit(5).alias("score"),
    ))
    found = feeds.read_posts(table(spark, d, "conversations").select("conv_id", "turn", post.alias("post")))
    return found.select("conv_id", "turn", "title", "url", "original_url", "summary", F.array_join("authors", "|").alias("authors"))


# ---- gates, dispatch, catalogues


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN 'blocked' WHEN s_suppkey % 5 = 0 AND s_nationkey > 10 THEN 'cooldown' WHEN s_suppkey % 7 = 0 THEN 'duplicate_job' WHEN s_acctbal < 0 THEN 'robots' ELSE 'fetch' END AS gate FROM supplier""")
def s5_fetch_gate(spark, d):
    k = F.col("s_suppkey")
    at = lambda hours: F.timestamp_seconds(F.lit(1_700_000_000) + hours * 3600)
    gate = feeds.fetch_gate(F.when(k % 17 == 0, "blocked"), F.when(k % 5 == 0, "COOLDOWN"), at(F.col("s_nationkey")), at(F.lit(10)), k % 7 == 0, F.col("s_acctbal") >= 0)
    return table(spark, d, "supplier").select("s_suppkey", gate.alias("gate"))


@query("""WITH r AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3), c AS (SELECT DISTINCT source, sha256(text) AS h FROM documents WHERE doc_id < 100 AND text IS NOT NULL)
  SELECT r.doc_id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = r.source AND c.h = r.h)""")
def s5_changed_documents(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    cache = docs.where("doc_id < 100").select("source", F.sha2("text", 256).alias("content_hash"))
    return feeds.changed(docs.withColumn("status_code", F.when(F.col("doc_id") % 10 == 3, 304).otherwise(200)), cache, "source", "text").select("doc_id")


#: By the length of a site's name: no file, rules for all, rules for this agent, and rules whose order decides.
ROBOTS = {1: "User-agent: *\nDisallow: /fr/\nAllow: /\nCrawl-delay: 7", 2: "User-agent: other\nDisallow: /\n\nUser-agent: Tide\nDisallow: /en/\nCrawl-delay: soon\n\nUser-agent: *\nDisallow: /", 3: "# all\nUser-agent: *\nAllow: /de/1\nDisallow: /de/\nDisallow:\nCrawl-delay: 2"}


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages), k AS (SELECT *, length(site) % 4 AS k FROM p)
  SELECT page_id, CASE k WHEN 1 THEN NOT starts_with(path, '/fr/') WHEN 2 THEN NOT starts_with(path, '/en/') WHEN 3 THEN starts_with(path, '/de/1') OR NOT starts_with(path, '/de/') ELSE true END AS allowed,
    CASE k WHEN 1 THEN 7.0::DOUBLE WHEN 3 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS delay, CASE WHEN k = 1 AND starts_with(path, '/fr/') OR k = 2 AND starts_with(path, '/en/') OR k = 3 AND starts_with(path, '/de/') AND NOT starts_with(path, '/de/1') THEN 'robots' ELSE 'fetch' END AS gate FROM k""")
def s5_robots(spark, d):
    """Addresses of pages under the robots files of their sites, which stand in a table of their own."""
    pages = table(spark, d, "pages").select("page_id", "url")
    sites = pages.select(robots.site_of(F.col("url")).alias("site")).distinct()
    text = F.create_map(*[F.lit(x) for pair in ROBOTS.items() for x in pair])[F.length("site") % 4]
    rules = robots.site_rules(sites.select("site", text.alias("robots")).where("robots IS NOT NULL"), "TideBot/1.0")
    rows = robots.with_robots(pages, rules)
    none = F.lit(None)
    gate = feeds.fetch_gate(none.cast("string"), none.cast("string"), none.cast("timestamp"), F.current_timestamp(), none.cast("boolean"), F.col("allowed"))
    return rows.select("page_id", "allowed", catalogue.effective_delay(F.lit(1.5), F.col("crawl_delay")).alias("delay"), gate.alias("gate"))


DISPATCH = """asked AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'html' WHEN 2 THEN 'headless' ELSE 'rss' END AS collector FROM supplier),
results AS (SELECT s_suppkey, s_acctbal > 0 AS ok, s_nationkey AS found, s_nationkey // 2 AS saved FROM supplier WHERE s_suppkey % 9 <> 0),
details AS (SELECT a.s_suppkey, a.collector, a.collector <> 'headless' AND coalesce(r.ok, false) AS success,
    CASE WHEN a.collector = 'headless' THEN 'collector_unavailable' WHEN r.ok IS NULL THEN 'child_source_missing' WHEN NOT r.ok THEN 'source_failed' END AS reason,
    CAST(CASE WHEN a.collector = 'headless' THEN 0 ELSE coalesce(r.found, 0) END AS BIGINT) AS found, CAST(CASE WHEN a.collector = 'headless' THEN 0 ELSE coalesce(r.saved, 0) END AS BIGINT) AS saved
  FROM asked a LEFT JOIN results r USING (s_suppkey))"""


def _dispatched(spark, d) -> DataFrame:
    rows = table(spark, d, "supplier")
    kinds = F.element_at(F.array(F.lit("RSS"), F.lit("html"), F.lit("headless"), F.lit("carrier pigeon")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    results = rows.where("s_suppkey % 9 <> 0").select("s_suppkey", (F.col("s_acctbal") > 0).alias("success"), F.col("s_nationkey").alias("found"), F.floor(F.col("s_nationkey") / 2).alias("saved"))
    return feeds.dispatched(rows.select("s_suppkey", kinds.alias("kind")), results, "s_suppkey", "kind", ("rss", "html", "reddit"))


@query(f"WITH {DISPATCH} SELECT * FROM details")
def s9_dispatch(spark, d):
    return _dispatched(spark, d)


@query(f"""WITH {DISPATCH} SELECT count(*) AS sources_processed, count(*) FILTER (success) AS sources_succeeded, count(*) FILTER (NOT success) AS sources_failed, CAST(sum(found) AS BIGINT) AS articles_found, CAST(sum(saved) AS BIGINT) AS articles_saved,
  round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 2) AS success_rate_percent FROM details""")
def a10_cycle_summary(spark, d):
    return feeds.cycle_summary(_dispatched(spark, d))


@query("SELECT CASE s_suppkey % 8 WHEN 0 THEN 'ELITE_JOURNALS' WHEN 1 THEN 'SCIENCE_MEDIA' WHEN 2 THEN 'AI_LABS' END AS bucket, count(*) AS n FROM supplier WHERE s_suppkey % 8 < 3 GROUP BY 1")
def s12_catalogue_buckets(spark, d):
    group = F.element_at(F.array(*map(F.lit, ("ELITE_JOURNALS", "SCIENCE_MEDIA", "AI_LABS", "NO_SUCH_GROUP"))), F.least(F.col("s_suppkey") % 8 + 1, F.lit(4)).cast("int"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), group.alias("_group"))
    return feeds.group_buckets(rows).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_nationkey % 5 AS category FROM supplier WHERE s_nationkey % 5 = 2 AND s_acctbal / 10000.0::DOUBLE >= 0.85 OR s_suppkey % 3 = 0 AND s_nationkey < 5")
def p13_catalogue_predicates(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("category"), (F.col("s_acctbal") / 10000.0).alias("credibility_score"),
                                              F.when(F.col("s_suppkey") % 3 == 0, "daily").alias("update_frequency"), F.when(F.col("s_nationkey") < 5, 1).alias("tier"))
    by = catalogue.source_filter
    return rows.where(by(category=2, credibility=0.85) | by(frequency="daily", tier=1)).select("s_suppkey", "category")


# ---- files


def _log(spark, d) -> DataFrame:
    rows = events(spark, d)
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.concat(F.lit("mod:"), F.col("user_id").cast("string")), F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return rows.select("event_id", F.when(F.col("event_id") % 10 == 9, "not a log line").otherwise(line).alias("value"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'mod:' || user_id AS place, 'event ' || event_id AS message FROM events WHERE event_id % 10 <> 9")
def s14_log_lines(spark, d):
    path = new_path(spark, "log")
    _log(spark, d).select("value").write.text(path)
    return readers.read_log(spark, path)


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'mod:' || user_id AS place, 'event ' || event_id AS message FROM events WHERE event_id % 10 <> 9")
def s14_followed_log(spark, d):
    """A log that is written in two parts and followed as a stream, from the bytes where each run stopped."""
    formats.register(spark)
    path, out, place = (new_path(spark, x) for x in ("log", "log-lines", "log-offsets"))
    stream = spark.readStream.format("tidemill_log").option("ends", ".txt").load(path).select("time", "level", "place", "message")
    lines = _log(spark, d)
    for half in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        lines.where(half).select("value").write.mode("append").text(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id, 'event ' || event_id AS message FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) WHERE event_id % 10 <> 9 ORDER BY event_id DESC LIMIT 50")
def s15_last_lines(spark, d):
    log = _log(spark, d).withColumn("readable", F.col("value").rlike(readers.LOG_LINE))
    tail = feeds.last_lines(log, "event_id", 50)
    return tail.select("event_id", F.regexp_extract("value", readers.LOG_LINE, 4).alias("message"))


@query("SELECT source AS source_id, 'https://example.com/' || doc_id AS link, split_part(text, chr(10), 1) AS title FROM documents WHERE text IS NOT NULL")
def s10_replay_lines(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    item = F.struct(F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("link"), F.substring_index("text", "\n", 1).alias("title"))
    path = new_path(spark, "replay")
    docs.select(F.col("source").alias("source_id"), F.lit(200).alias("status_code"), F.array(item).alias("articles")).write.json(path)
    return readers.replay_articles(readers.read_replay(spark, path)).select("source_id", "link", "title")


@query("SELECT event_type AS source_id, CAST(count(*) AS INTEGER) AS articles_found, count(*) / 2.0::DOUBLE AS expected_articles_per_window, CAST(count(*) FILTER (value > 50) AS INTEGER) AS languages_en FROM events GROUP BY 1")
def s13_monitoring_file(spark, d):
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("value") > 50).cast("int").alias("en"))
    window = F.struct("source_id", F.col("n").alias("articles_found"), F.create_map(F.lit("en"), F.col("en")).alias("languages"))
    base = F.struct(F.col("source_id").alias("key"), F.struct((F.col("n") / 2.0).alias("expected_articles_per_window")).alias("value"))
    path = new_path(spark, "monitoring")
    per.agg(F.collect_list(window).alias("source_windows"), F.map_from_entries(F.collect_list(base)).alias("baselines")).write.json(path)  # a few sources
    windows, baselines = readers.read_monitoring(spark, path)
    return windows.join(baselines, "source_id").select("source_id", "articles_found", "expected_articles_per_window", F.col("languages")["en"].alias("languages_en"))


@query("SELECT item_id, 'Title ' || item_id AS title, length(text) AS n_chars FROM benchmark")
def s16_front_matter(spark, d):
    path = new_path(spark, "posts")
    key = F.col("item_id").cast("string")
    page = F.concat(F.lit("---\ntitle: Title "), key, F.lit("\nid: "), key, F.lit("\n---\n"), F.regexp_replace("text", "\n", " "))
    table(spark, d, "benchmark").select(F.col("item_id").alias("post"), page.alias("value")).repartition("post").write.partitionBy("post").text(path)
    found = readers.read_front_matter(spark, f"{path}/*/*.txt")
    return found.select(F.col("front")["id"].cast("long").alias("item_id"), F.col("front")["title"].alias("title"), F.length(F.regexp_replace("body", "\n$", "")).alias("n_chars"))


@query("""SELECT item_id, 'Title: ' || item_id AS title, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'https://blog.example.com/posts/' || item_id || '/' END AS published_url,
  CASE item_id % 4 WHEN 0 THEN 'https://a.example.com/' || item_id WHEN 1 THEN 'https://b.example.com/' || item_id WHEN 2 THEN 'https://c.example.com/' || item_id END AS source_url, length(text) AS n_chars FROM benchmark""")
def f30_published_urls(spark, d):
    """Posts written as Markdown files and read back, with the addresses that their front matter and bodies name."""
    formats.register(spark)
    key, kind, path = F.col("item_id").cast("string"), F.col("item_id") % 4, new_path(spark, "posts")
    at = lambda host: F.concat(F.lit(f"https://{host}.example.com/"), key)
    front = F.map_filter(
        F.create_map(
            F.lit("title"), F.concat(F.lit("Title: "), key), F.lit("id"), key, F.lit("permalink"), F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("/posts/"), key, F.lit("/"))),
            F.lit("source_url"), F.when(kind == 0, at("a")), F.lit("original_url"), F.when(kind < 2, at("b")),
        ), lambda k, v: v.isNotNull(),
    )
    body = F.when(kind == 2, F.concat("text", F.lit("\n\nFuente original: "), at("c"))).otherwise(F.col("text"))
    posts = table(spark, d, "benchmark").select(F.concat(F.lit("post-"), key).alias("name"), front.alias("front"), body.alias("body"))
    posts.write.format("tidemill_posts").mode("append").save(path)
    rows = spark.read.format("tidemill_posts").option("site", "https://blog.example.com").load(path)
    text = F.regexp_replace("body", r"\n\nFuente original: \S+$", "")
    return rows.select(F.col("front")["id"].cast("long").alias("item_id"), F.col("front")["title"].alias("title"), "published_url", "source_url", F.length(text).cast("long").alias("n_chars"))


@query("SELECT user_id, count(*) AS attempted, round(count(*) FILTER (event_type = 'purchase') / count(*), 3) AS save_ratio FROM events GROUP BY 1")
def s18_health_file(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("attempted"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 3).alias("save_ratio"))
    path = new_path(spark, "health")
    readers.write_health(per, path)
    return spark.read.schema(per.schema).json(path)


@query("SELECT substr(sha256(source || '|' || 'https://example.com/' || doc_id || '|' || doc_id), 1, 12) AS key, source FROM documents WHERE text IS NULL OR length(text) < 40")
def s19_rejects(spark, d):
    bad = table(spark, d, "documents").where("text IS NULL OR length(text) < 40").withColumn("url", F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")))
    rejects = bad.select(readers.reject_key("source", "url", "doc_id").alias("key"), "source")
    path = new_path(spark, "rejects")
    readers.write_rejects(rejects, path)
    return spark.read.schema("key string, source string").json(path)


@query("SELECT '2.0' AS version, doc_id, source FROM documents")
def s17_export(spark, d):
    path = new_path(spark, "export")
    readers.write_export(table(spark, d, "documents").select("doc_id", "source"), path)
    return spark.read.schema("version string, article struct<doc_id:long,source:string>").json(path).select("version", "article.doc_id", "article.source")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s20_read_only_view(spark, d):
    path = new_path(spark, "metrics")
    table(spark, d, "events").select("event_type").write.parquet(path)
    readers.read_only_view(spark.read.parquet(path), "metrics_snapshot")
    return spark.sql("SELECT event_type, count(*) AS n FROM metrics_snapshot GROUP BY event_type")


@query("SELECT * FROM (VALUES ('lang', 'int', 'string'), ('missing', 'double', NULL), ('n_chars', NULL, 'bigint')) t(\"column\", expected, found)")
def s22_schema_check(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return readers.schema_issues(docs, {"doc_id": "bigint", "text": "string", "lang": "int", "source": "string", "missing": "double"})


@query("SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'jdbc:sqlite:/data/' || n_name ELSE 'jdbc:postgresql://db:5432/' || n_name END AS url FROM nation")
def s2_database_urls(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # configurations, not data
    made = [(r["n_name"], readers.database_url({"type": "sqlite", "path": f"/data/{r['n_name']}"} if r["n_nationkey"] % 2 == 0 else {"type": "postgresql", "host": "db", "port": 5432, "name": r["n_name"]})) for r in rows]
    return spark.createDataFrame(made, "n_name string, url string")


# ---- enrichment


def _keyword_sql(text: str, words) -> str:
    single = [w for w in dict.fromkeys(words) if " " not in w]
    phrases = [w for w in dict.fromkeys(words) if " " in w]
    lists = f"len(list_intersect(tokens, [{', '.join(map(sql_text, single))}]))" if single else "0"
    return " + ".join([lists, *(f"CAST(contains({text}, {sql_text(w)}) AS INTEGER)" for w in phrases)])


def _by_language(made) -> str:
    return "CASE lang " + " ".join(f"WHEN '{n}' THEN {made(n)}" for n in W.LANGUAGES) + " END"


#: Texts without markup: entities resolved, white space collapsed.
NORMAL = r"trim(regexp_replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{{00A0}}]+', ' ', 'g'))"
PLAIN = """SELECT doc_id, lang, text || ' ' || CASE doc_id % 6 WHEN 0 THEN 'NASA research on Mars and the climate' WHEN 1 THEN 'La recesión y el Ministerio de Salud de Chile: avance' WHEN 2 THEN 'ministry of health, risk and progress' WHEN 3 THEN 'São Paulo IA software' ELSE '' END AS text FROM documents WHERE text IS NOT NULL"""
WHOLE = f"""SELECT doc_id, lang, {NORMAL.format("split_part(text, chr(10), 1)")} AS normalized_title, {NORMAL.format("text")} AS normalized_summary, trim(normalized_title || ' ' || normalized_summary) || ' ' || split_part(text, chr(10), 1) || ' ' || text AS text FROM ({PLAIN})"""


def _enriched(rows: str) -> str:
    return rf"""told AS (SELECT * REPLACE (CASE WHEN lang IN ('en', 'es', 'pt', 'fr') THEN lang ELSE 'en' END AS lang), lower(text) AS low, string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+') AS tokens FROM ({rows})),
judged AS (SELECT *, {_by_language(lambda n: _keyword_sql("low", W.POSITIVE["shared"] + W.POSITIVE[n]))} AS up, {_by_language(lambda n: _keyword_sql("low", W.NEGATIVE["shared"] + W.NEGATIVE[n]))} AS down FROM told)"""


def _texts(spark, d) -> DataFrame:
    i = F.col("doc_id") % 6
    more = F.when(i == 0, "NASA research on Mars and the climate").when(i == 1, "La recesión y el Ministerio de Salud de Chile: avance").when(i == 2, "ministry of health, risk and progress").when(i == 3, "São Paulo IA software").otherwise("")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.concat("text", F.lit(" "), more).alias("text"))


TOPIC_LIST = ", ".join(f"CASE WHEN {_by_language(lambda n, k=k: _keyword_sql('low', k['shared'] + k[n]))} > 0 THEN '{t}' END" for t, k in W.TOPICS.items())
ENTITY_AT = lambda p, exact: f"instr(text, {sql_text(p)})" if exact else f"instr({ACCENTS_SQL.format('low')}, {ACCENTS_SQL.format(f'lower({sql_text(p)})')})"
ENTITY_LIST = _by_language(lambda n: "[" + ", ".join(f"{{'a': {ENTITY_AT(p, x)}, 'k': {i}, 'n': {sql_text(p)}}}" for i, (p, x) in enumerate(W.ENTITIES["shared"] + W.ENTITIES[n])) + "]")


@query(rf"""WITH {_enriched(WHOLE)}, listed AS (SELECT *, list_filter([{TOPIC_LIST}], lambda x: x IS NOT NULL) AS found, list_sort(list_filter({ENTITY_LIST}, lambda x: x.a > 0)) AS names FROM judged)
  SELECT doc_id, lang AS language, normalized_title, normalized_summary, CASE WHEN len(found) = 0 THEN 'general' ELSE array_to_string(found[1:5], '|') END AS topics, CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS sentiment,
    array_to_string(list_transform(names, lambda x: x.n), '|') AS entities, '{E.MODEL_VERSION}' AS model_version FROM listed""")
def f10_enrichment(spark, d):
    none = F.lit(None).cast("string")
    title = F.substring_index("text", "\n", 1)
    rows = _texts(spark, d).select("doc_id", E.enrichment(title, none, F.col("text"), F.col("lang")).alias("e"))
    return rows.select("doc_id", "e.language", "e.normalized_title", "e.normalized_summary", F.array_join("e.topics", "|").alias("topics"), "e.sentiment", F.array_join("e.entities", "|").alias("entities"), "e.model_version")


def _told(spark, d, made) -> DataFrame:
    language = E.resolve_language(F.col("lang"), F.lit(""))
    return _texts(spark, d).select("doc_id", made(F.col("text"), language))


@query(f"WITH {_enriched(PLAIN)}, listed AS (SELECT doc_id, list_sort(list_filter({ENTITY_LIST}, lambda x: x.a > 0)) AS names FROM judged) SELECT doc_id, list_transform(names, lambda x: x.n) AS entities FROM listed")
def f7_entities(spark, d):
    return _told(spark, d, lambda t, n: E.entities(t, n).alias("entities"))


@query(f"WITH {_enriched(PLAIN)}, listed AS (SELECT doc_id, list_filter([{TOPIC_LIST}], lambda x: x IS NOT NULL) AS found FROM judged) SELECT doc_id, CASE WHEN len(found) = 0 THEN 'general' ELSE array_to_string(found[1:5], '|') END AS topics FROM listed")
def f8_topics(spark, d):
    return _told(spark, d, lambda t, n: F.array_join(E.topics(t, n), "|").alias("topics"))


@query(f"WITH {_enriched(PLAIN)} SELECT doc_id, CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS sentiment FROM judged")
def f9_sentiment(spark, d):
    return _told(spark, d, lambda t, n: E.sentiment(t, n).alias("sentiment"))


#: How the time of an event is written down, by its id: a form, and the zone with its minutes and the name it is given.
ZONED = {0: ("mail", "+0200", 120, "UTC+02:00"), 1: ("iso", "Z", 0, "UTC"), 2: ("mail", "-0330", -210, "UTC-03:30"), 4: ("mail", "EST", -300, "UTC-05:00"), 5: ("mail", "PDT", -420, "UTC-07:00"), 6: ("mail", "GMT", 0, "UTC"), 7: ("iso", "-08:00", -480, "UTC-08:00"), 8: ("mail", "XYZ", 0, "XYZ"), 9: ("iso", "", 0, "UTC")}
_zone_case = lambda part: "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {part(v)}" for k, v in ZONED.items()) + " END"


@query(f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, {_zone_case(lambda v: v[2])} AS m, {_zone_case(lambda v: f"'{v[3]}'")} AS zone FROM events)
  SELECT event_id, strftime(ts - to_minutes(m), '%Y-%m-%d %H:%M:%S') AS utc, m AS offset_minutes, zone FROM e""")
def f13_stamps(spark, d):
    """The clock of each event, written with a zone; a tenth are no dates."""
    k, text = F.col("event_id") % 10, F.lit("yesterday")
    for i, (form, zone, *_) in ZONED.items():
        clock = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss" if form == "mail" else "yyyy-MM-dd'T'HH:mm:ss")
        text = F.when(k == i, F.concat(clock, F.lit(f" {zone}" if form == "mail" else zone))).otherwise(text)
    rows = events(spark, d).select("event_id", E.parse_stamp(text).alias("s"))
    return rows.select("event_id", F.date_format("s.utc", "yyyy-MM-dd HH:mm:ss").alias("utc"), F.col("s.offset_minutes").alias("offset_minutes"), F.col("s.zone").alias("zone"))


@query("""WITH l AS (SELECT event_id, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Santiago' AS local FROM events), o AS (SELECT *, CAST(date_diff('minute', ts, local) AS BIGINT) AS m FROM l)
  SELECT event_id, strftime(local, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') AS shown FROM o""")
def f14_display_times(spark, d):
    return events(spark, d).select("event_id", E.display_time(F.date_trunc("second", "ts")).alias("shown"))


TAG_WORDS = ("Energía_Oscura", "energia oscura", "A.I.", "x", "noticias", "SPACE-X", "", "clima  global", "una etiqueta demasiado larga para ser una etiqueta util", "ciencia", "quimica", "Química", "bio", "geo", "astro")


def _tags(spark, d) -> DataFrame:
    words = F.array(*map(F.lit, TAG_WORDS))
    n = (F.col("doc_id") % 11 + 3).cast("int")
    picked = F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at(words, ((F.col("doc_id") * 7 + i * 4) % len(TAG_WORDS) + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", picked.alias("tags"))


RULES = dict(stop=("noticias",), spelling={"quimica": "química"}, alias={"space x": "spacex"}, short=("ai",))


FOLDED_TAG = ACCENTS_SQL.format("{}")
TAGS_SQL = f"""WITH w AS (SELECT [{", ".join(map(sql_text, TAG_WORDS))}] AS words),
  g AS (SELECT doc_id, list_transform(range(0, doc_id % 11 + 4), lambda i: words[(doc_id * 7 + i * 4) % {len(TAG_WORDS)} + 1]) AS given FROM documents, w),
  c AS (SELECT doc_id, list_transform(given, lambda t: {{'given': t, 'tag': regexp_replace(replace(regexp_replace(lower(trim(t)), '[-_]', ' ', 'g'), '.', ''), '\\s+', ' ', 'g')}}) AS c FROM g),
  k AS (SELECT doc_id, c, list_filter(c, lambda x: x.tag = '' OR x.tag = 'noticias') AS gone, list_transform(list_filter(c, lambda x: x.tag <> '' AND x.tag <> 'noticias'), lambda x: {{'a': x.tag, 'b': CASE x.tag WHEN 'quimica' THEN 'química' ELSE x.tag END}}) AS ab FROM c),
  s AS (SELECT *, list_transform(ab, lambda x: {{'a': x.a, 'b': x.b, 'c': CASE x.b WHEN 'space x' THEN 'spacex' ELSE x.b END}}) AS spelt, list_transform(spelt, lambda x: x.c) AS final, list_transform(final, lambda t: {FOLDED_TAG.format("t")}) AS folded FROM k),
  f AS (SELECT *, list_filter(final, lambda t, i: list_position(folded, {FOLDED_TAG.format("t")}) = i) AS firsts FROM s),
  r AS (SELECT *, list_filter(firsts, lambda t: (length(t) >= 3 OR t = 'ai') AND length(t) <= 40) AS fit, list_filter(firsts, lambda t: NOT ((length(t) >= 3 OR t = 'ai') AND length(t) <= 40)) AS unfit FROM f)
  SELECT doc_id, array_to_string(fit[1:8], '|') AS tags, array_to_string(list_concat(list_transform(gone, lambda x: CASE x.tag WHEN '' THEN x.given ELSE x.tag END), unfit), '|') AS removed,
    array_to_string(flatten(list_transform(spelt, lambda x: list_filter([CASE WHEN x.a <> x.b THEN x.a || '>' || x.b END, CASE WHEN x.b <> x.c THEN x.b || '>' || x.c END], lambda y: y IS NOT NULL))), '|') AS replaced,
    array_to_string(list_filter(list_transform(final, lambda t, i: CASE WHEN list_position(folded, {FOLDED_TAG.format("t")}) < i AND final[list_position(folded, {FOLDED_TAG.format("t")})] <> t THEN final[list_position(folded, {FOLDED_TAG.format("t")})] || '>' || t END), lambda y: y IS NOT NULL), '|') AS merged,
    array_to_string(list_concat(list_concat(list_transform(list_filter(c, lambda x: x.tag = 'noticias'), lambda x: 'removed stop tag: ' || x.tag), list_transform(unfit, lambda t: CASE WHEN length(t) > 40 THEN 'removed long tag: ' ELSE 'removed short tag: ' END || t)),
      CASE WHEN len(fit) > 8 THEN ['truncated tags to max 8'] ELSE [] END), '|') AS warnings FROM r"""


@query(TAGS_SQL)
def f17_clean_tags(spark, d):
    rows = _tags(spark, d).select("doc_id", E.sanitize_tags(F.col("tags"), **RULES).alias("r"))
    return rows.select("doc_id", *[F.array_join(f"r.{c}", "|").alias(c) for c in ("tags", "removed", "replaced", "merged", "warnings")])


@query(f"""WITH w AS (SELECT [{", ".join(map(sql_text, TAG_WORDS))}] AS words),
  t AS (SELECT doc_id, list_transform(range(0, doc_id % 11 + 4), lambda i: words[(doc_id * 7 + i * 4) % {len(TAG_WORDS)} + 1]) AS tags FROM documents, w),
  e AS (SELECT *, flatten(list_transform(tags, lambda t: list_filter([
    CASE WHEN NOT regexp_full_match(t, '[a-z0-9áéíóúüñ\\s]+') THEN 'Invalid characters in tag: ''' || t || '''' END, CASE WHEN t = 'noticias' THEN 'Forbidden stop tag found: ''' || t || '''' END,
    CASE WHEN length(t) < 3 THEN 'Tag too short: ''' || t || '''' END, CASE WHEN length(t) > 40 THEN 'Tag too long: ''' || t || '''' END], lambda x: x IS NOT NULL))) AS errors FROM t)
  SELECT doc_id, len(errors) = 0 AS is_valid, len(list_filter(tags, lambda t: NOT regexp_full_match(t, '[a-z0-9áéíóúüñ\\s]+') OR t = 'noticias')) > 0 AS needs_review, array_to_string(errors, '|') AS errors,
    CASE WHEN len(tags) > 8 THEN 'Tag count (' || len(tags) || ') exceeds limit (8)' ELSE '' END AS warnings FROM e""")
def f18_validated_tags(spark, d):
    rows = _tags(spark, d).select("doc_id", E.validate_tags(F.col("tags"), stop=("noticias",)).alias("r"))
    return rows.select("doc_id", "r.is_valid", "r.needs_review", F.array_join("r.errors", "|").alias("errors"), F.array_join("r.warnings", "|").alias("warnings"))


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(source || '|', '') || lang WHEN doc_id % 3 = 1 THEN array_to_string(list_filter(string_split_regex(coalesce(text, ''), '{SPACES}')[1:3], lambda w: w <> ''), '|') ELSE '' END AS topics FROM documents""")
def f21_article_topics(spark, d):
    """Topics in the metadata of a third of the documents, keywords in that of another, neither in the rest."""
    i = F.col("doc_id") % 3
    held = F.to_json(F.struct(F.struct(F.array_compact(F.array("source", "lang")).alias("topics")).alias("enrichment")))
    metadata = F.when(i == 0, held).when(i == 1, F.lit('{"enrichment":{"topics":[]}}'))
    words = F.filter(F.slice(F.split(F.coalesce("text", F.lit("")), r"[ \t\r\n\x0B\f]+"), 1, 3), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(E.article_topics(metadata, F.when(i == 1, words)), "|").alias("topics"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS folder FROM pages),
  every AS (SELECT page_id, 0 AS place, regexp_extract(root, '^https?:') || '//cdn.example.com/' || page_id || '.jpg' AS url, 'meta:og:image' AS source, 10.0::DOUBLE AS score, CAST(NULL AS INTEGER) AS width FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1 ELSE 0 END, root || '/img/' || page_id || '.jpg', 'dom', 3.0::DOUBLE, CAST(601 + page_id % 300 AS INTEGER) FROM p WHERE page_id % 3 < 2
  UNION ALL SELECT page_id, CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, folder || 'plain.jpg', 'dom', 1.0::DOUBLE, NULL FROM p)
  SELECT * FROM every WHERE source <> 'dom' OR NOT regexp_matches(lower(url), '{images.NO_PICTURE}')""")
def f22_image_candidates(spark, d):
    """Pages as they are, with pictures put before and into their articles: icons, small ones, logos, repeats, and other schemes among them."""
    key = F.col("page_id").cast("string")
    head = F.concat(F.lit('<meta property="og:image" content="//cdn.example.com/'), key, F.lit('.jpg"></head>'))
    wide = F.concat(F.lit('<IMG data-src="/img/'), key, F.lit(".jpg\" src='x.gif' width='"), (601 + F.col("page_id") % 300).cast("string"), F.lit("px' height=500>"))
    rest = F.lit(
        '<img src="/img/logo.png"><img src="/img/small.jpg" width="100"><img class="site-logo" src="/img/x.jpg"><img src="plain.jpg"><img src="./plain.jpg">'
        '<img src="data:image/png;base64,AA"><img src="" data-original="mailto:x">'
    )
    third = F.col("page_id") % 3
    html = F.when(third == 0, F.replace("html", F.lit("</head>"), head)).otherwise(F.col("html"))
    inside = F.concat(F.lit("<article>"), rest, F.when(third < 2, wide).otherwise(F.lit("")))
    html = F.concat(F.lit('<img src="/img/outside.jpg">'), F.replace(html, F.lit("<article>"), inside))
    rows = table(spark, d, "pages").select("page_id", "url", html.alias("html"))
    return images.page_images(rows, "html", "url", "page_id").select("page_id", "place", "url", "source", "score", "width")
