"""Sources of articles as column expressions over documents that are read whole: feeds, index pages, posts, catalogues.

Fetching is not Spark's work: raw documents are landed, and these operators gate the fetches and read what came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.feed_xml import FeedReader
from tidemill.functions.urls import canonical_column, joined_url
from tidemill.operators.dedup import written
from tidemill.sources.nodes import first_inside, node_table, selected, texts_inside
from tidemill.sources.readers import LEAST_TITLE, MOST_ENTRIES

#: Types of pages that list articles, groups of the catalogue, names that are no author.
LISTS = ("ItemList", "Blog", "NewsMediaOrganization")
GROUPS = ("ELITE_JOURNALS", "SCIENCE_MEDIA", "INSTITUTIONAL_SOURCES", "PREPRINT_SOURCES", "COMMUNITY_FEEDS", "AI_LABS")
NO_AUTHOR = ("[deleted]", "AutoModerator")
REDDIT, LEAST_POST = "https://www.reddit.com", 10
COLLECTORS = ("rss", "html", "reddit", "headless")
BROKEN_BUT_READ = ("InvalidDocument", "UndeclaredNamespace", "SAXParseException")
DOI = r"(?i)10\.\d{4,}/[-._;()/:\w\[\]]+[^.\s]"

#: Raw fields of an item, as the parser finds them.
FOUND = pa.schema([
    ("place", pa.int32()), ("title_text", pa.string()), ("link_text", pa.string()), ("texts", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("tags", pa.list_(pa.string())),
    ("image_url", pa.string()), ("entry_id", pa.string()), ("stamp", pa.string()), ("feed_title", pa.string()), ("error", pa.string()),
])
FOUND_DDL = "place int, title_text string, link_text string, texts array<string>, names array<string>, tags array<string>, image_url string, entry_id string, stamp string, feed_title string, error string"
POST = "title string, permalink string, url string, selftext string, created_utc double, author string, score long, num_comments long, subreddit string, link_flair_text string"
LISTED = "headline string, name string, url string, description string, datePublished string"


def strip_tags(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "), r"\s+", " "))


def _reading(rest: list[str], text: str, most: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of items as the parser finds them, and one row without a place for each feed, with its title and error."""
    kinds = {f.name: f.type for f in FOUND}

    def rows_of(document: str | None) -> list[dict]:
        reader = FeedReader(document or "")
        rows = []
        for place, item in enumerate(reader.items(most, whole)):
            content = [item.text(t) for t in ("summary", "description", "content:encoded", "content")]
            names = [item.text("author"), item.text("dc:creator"), *(e.text for e in item.all("name"))]
            tags = [t for e in item.all("category") for t in (e.text.strip() or e.attributes.get("term", "").strip(),) if t]
            stamp = item.text("pubDate", "published", "updated", "dc:date")
            rows.append({"place": place, "title_text": item.text("title"), "link_text": item.link(), "texts": content, "names": [n for n in names if n], "tags": tags, "image_url": item.image(), "entry_id": item.text("guid", "id"), "stamp": stamp})
        return [r | {"feed_title": reader.title, "error": reader.error} for r in [*rows, {"place": None}]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, document in enumerate(batch.column(text)):
                rows = rows_of(document.as_py())
                given = [pa.concat_arrays([batch.column(c).slice(i, 1)] * len(rows)) for c in rest]
                made = [pa.array([r.get(n) for r in rows], kind) for n, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*given, *made], names=[*rest, *kinds])

    return run


def read_feeds(feeds: DataFrame, text: str = "feed", most: int = MOST_ENTRIES, whole: bool = False) -> DataFrame:
    """The columns of feeds but the text, and what the parser finds: raw fields of the first `most` items of each feed, and
    a row without a place for each feed; feed_title and error are in all of them. With `whole`, errors behind those items count too."""
    rest = [f for f in feeds.schema if f.name != text]
    schema = T.StructType([*rest, *T.StructType.fromDDL(FOUND_DDL).fields])
    return feeds.select(*[f.name for f in rest], text).mapInArrow(_reading([f.name for f in rest], text, most, whole), schema)


def feed_items(feeds: DataFrame, text: str = "feed", most: int = MOST_ENTRIES) -> DataFrame:
    """One row for each readable item of RSS or Atom feeds: the columns of feeds but the text, and place, title, url,
    original_url, summary, stamp (its date as text), authors, image_url, doi, tags, feed_title, entry_id.

    What is broken in an item, or around it, costs that item at most. The first `most` of a feed count; items without a
    link, or with a title of less than LEAST_TITLE letters, are left out.
    """
    rest = [F.col(c) for c in feeds.columns if c != text]
    rows = read_feeds(feeds, text, most).where("place IS NOT NULL")
    link = F.col("link_text")
    title = F.trim(F.regexp_replace(F.coalesce("title_text", F.lit("Sin título")), r"\s+", " "))
    texts = F.transform("texts", strip_tags)
    summary = F.coalesce(F.get(F.filter(texts, lambda t: F.length(t) >= 10), F.lit(0)), F.lit(""))
    plain = F.transform("names", lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, "<[^>]*>", ""), r"\s+", " ")))
    authors = F.array_sort(F.array_distinct(F.concat(plain, F.filter("tags", lambda t: F.contains(F.lower(t), F.lit("author"))))))
    doi = F.coalesce(*[F.when(c.rlike(DOI), F.regexp_extract(c, DOI, 0)) for c in (F.col("entry_id"), F.get(texts, F.lit(0)), F.get(texts, F.lit(1)), link)])
    made = rows.select(
        *rest, "place", title.alias("title"), canonical_column(link).alias("url"), link.alias("original_url"), summary.alias("summary"), "stamp",
        F.filter(authors, lambda a: a != "").alias("authors"), "image_url", doi.alias("doi"), "tags", "feed_title", "entry_id",
    )
    return made.where(F.col("original_url").isNotNull() & (F.length("title") >= LEAST_TITLE))


def feed_errors(feeds: DataFrame, text: str = "feed", most: int = MOST_ENTRIES) -> DataFrame:
    """The columns of feeds but the text, feed_title, n_items, error (the class of the first error in the whole feed, null if there is none) and
    accepted: whether the feed is read in spite of it."""
    rest = [c for c in feeds.columns if c != text]
    per = read_feeds(feeds, text, most, whole=True).groupBy(*rest).agg(F.count("place").alias("n_items"), F.max("feed_title").alias("feed_title"), F.max("error").alias("error"))
    return per.withColumn("accepted", acceptable_feed(F.col("error")))


def acceptable_feed(error: Column) -> Column:
    """Whether a feed is read in spite of the error that its parser reports."""
    return error.isNull() | error.isin(*BROKEN_BUT_READ)


def escape_xml(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def replay_queue(events: DataFrame, source: str, order: str) -> DataFrame:
    """Events with their turn among those of their source: the n-th request of a source is answered by turn n."""
    return events.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1)


def answered(requests: DataFrame, queue: DataFrame, source: str) -> DataFrame:
    """Requests (source, turn) with the event that answers each; the state is unknown_source, exhausted or ok."""
    known = queue.select(F.col(source).alias("_known")).distinct()
    joined = requests.join(queue, [source, "turn"], "left").join(known, F.col(source) == F.col("_known"), "left")
    state = F.when(F.col("_known").isNull(), "unknown_source").when(F.col("answer").isNull(), "exhausted").otherwise("ok")
    return joined.withColumn("state", state).drop("_known")


def render_feed(title: Column, url: Column, source: Column, articles: Column) -> Column:
    """An RSS document of an array of (title, link, summary, authors, tags, published)."""
    tag = lambda name, text: F.concat(F.lit(f"<{name}>"), escape_xml(text), F.lit(f"</{name}>"))
    blank = F.lit("")

    def item(a: Column) -> Column:
        author = F.when(F.size(a["authors"]) > 0, tag("author", F.array_join(a["authors"], ", "))).otherwise(blank)
        day = F.when(F.coalesce(a["published"], blank) != "", tag("pubDate", a["published"])).otherwise(blank)
        categories = F.array_join(F.transform(F.coalesce(a["tags"], F.array().cast("array<string>")), lambda t: tag("category", t)), "")
        return F.concat(F.lit("<item>"), tag("title", a["title"]), tag("link", a["link"]), tag("guid", a["link"]), author, tag("description", a["summary"]), day, categories, F.lit("</item>"))

    head = F.concat(tag("title", title), tag("link", url), tag("description", F.concat(F.lit("Replay feed for "), source)))
    body = F.array_join(F.transform(articles, item), "")
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), head, body, F.lit("</channel></rss>"))


def listed_articles(pages: DataFrame, html: str, base: str, key: str, container: str = "article", link: str = "a", title: str = "h2, h3") -> DataFrame:
    """The articles that index pages list: key and base of pages, and place, title, url, description, date.

    Lists in JSON-LD come first; a page without any is read by selectors: each container's first link (`self`: the container)
    and title, or the link's text if that is empty. Containers may nest; each lists its own. Articles without an address or a title are left out.
    """
    nodes = written(node_table(pages.select(key, html), html), "nodes")
    # texts of scripts are not part of what a page shows
    scripts = nodes.where((F.col("tag") == "script") & (F.lower(F.col("attributes")["type"]) == "application/ld+json"))
    payload = texts_inside(scripts, nodes, key).select(key, "pre", "text")
    item = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in LISTED.split(', '))}>>"
    lists = payload.select(key, "pre", F.from_json("text", f"struct<`@type`:string,itemListElement:{item},blogPost:{item}>").alias("s")).where(F.col("s.`@type`").isin(*LISTS))
    some = F.coalesce(F.when(F.size("s.itemListElement") > 0, F.col("s.itemListElement")), F.col("s.blogPost"))
    blank = F.lit("")
    named = lists.select(key, "pre", F.posexplode(some).alias("at", "r")).where("r IS NOT NULL").select(
        key, F.struct("pre", "at").alias("at"), F.coalesce(F.when(F.col("r.headline") != "", F.col("r.headline")), F.col("r.name"), blank).alias("title"), F.coalesce("r.url", blank).alias("url"),
        F.coalesce("r.description", blank).alias("description"), F.coalesce("r.datePublished", blank).alias("date"),
    )
    boxes = selected(nodes, container, key).select(key, "pre", "last", "attributes")
    if link == "self":
        links = boxes.select(key, F.col("pre").alias("box"), F.struct("pre", "last", "attributes").alias("found"))
    else:
        links = first_inside(boxes, nodes, link, key)
    links = links.where(F.col("found.attributes")["href"].isNotNull()).select(key, "box", F.col("found.attributes")["href"].alias("url"), F.col("found.pre").alias("pre"), F.col("found.last").alias("last"))
    heads = first_inside(boxes, nodes, title, key).select(key, "box", "found.pre", "found.last")
    of = lambda rows, name: texts_inside(rows, nodes, key, "box").withColumnRenamed("text", name)
    read = links.join(of(heads, "head"), [key, "box"], "left").join(of(links, "label"), [key, "box"], "left")
    read = read.join(named.select(key).distinct(), key, "left_anti").select(
        key, F.struct(F.col("box").alias("pre"), F.lit(0).alias("at")).alias("at"), F.coalesce(F.when(F.col("head") != "", F.col("head")), F.col("label"), blank).alias("title"), "url",
        blank.alias("description"), F.lit(None).cast("string").alias("date"),
    )
    found = named.unionByName(read).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).where("url <> '' AND title <> ''")
    out = found.join(pages.select(key, base), key)
    url = F.when(F.startswith("url", F.lit("http")), F.col("url")).otherwise(joined_url(F.col(base), F.col("url")))
    return out.select(key, base, "place", "title", url.alias("url"), "description", "date")


def read_posts(posts: DataFrame, json: str = "post") -> DataFrame:
    """Articles of community posts (JSON objects): removed texts are empty, posts with short titles are left out."""
    rest = [F.col(c) for c in posts.columns if c != json]
    p = F.col("p")
    rows = posts.select(*rest, F.from_json(json, POST).alias("p"))
    title, link = F.trim(F.coalesce(p["title"], F.lit(""))), F.concat(F.lit(REDDIT), p["permalink"])
    body = F.trim(F.coalesce(p["selftext"], F.lit("")))
    body = F.when(body.isin("[removed]", "[deleted]"), "").otherwise(body)
    linked = F.coalesce(F.when(p["url"] != "", p["url"]), link)
    author = F.when((F.coalesce(p["author"], F.lit("")) != "") & ~p["author"].isin(*NO_AUTHOR), F.array(p["author"])).otherwise(F.array().cast("array<string>"))
    made = rows.select(
        *rest, link.alias("url"), F.when(linked != link, linked).alias("original_url"), title.alias("title"),
        F.when(body == "", title).otherwise(F.concat_ws("\n\n", title, body)).alias("summary"), F.when(body != "", body).alias("content"),
        F.timestamp_seconds(p["created_utc"]).alias("published"), author.alias("authors"), p["score"].alias("post_score"), p["num_comments"].alias("n_comments"),
        p["subreddit"].alias("community"), p["link_flair_text"].alias("flair"), F.lit("summary_only").alias("content_mode"),
    )
    return made.where((F.length("title") >= LEAST_POST) & F.col("url").isNotNull())


def fetch_gate(status: Column, state: Column, retry: Column, now: Column, job_known: Column, robots: Column) -> Column:
    """What becomes of a source's turn: the first gate that holds it, or fetch."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(status == "blocked"), "blocked").when(yes((state == "COOLDOWN") & (retry > now)), "cooldown").when(yes(job_known), "duplicate_job")
        .when(~F.coalesce(robots, F.lit(True)), "robots").otherwise("fetch")
    )


def changed(fetched: DataFrame, cache: DataFrame, source: str, body: str) -> DataFrame:
    """Fetched documents that are new: answered by other than 304 and with a hash that the cache does not hold."""
    rows = fetched.withColumn("content_hash", F.sha2(F.col(body), 256)).where(F.col("status_code") != 304)
    return rows.join(cache.select(source, "content_hash"), [source, "content_hash"], "left_anti")


def dispatched(sources: DataFrame, results: DataFrame, source: str, kind: str, available: tuple[str, ...] = COLLECTORS) -> DataFrame:
    """One row for each requested source: its collector (rss where the type is unknown), success and reason.

    A source whose collector is not available fails, and so does one that its collector's results leave out;
    unrequested results are dropped. So succeeded and failed sources add up to those requested.
    """
    known = F.when(F.lower(kind).isin(*COLLECTORS), F.lower(kind)).otherwise("rss")
    asked = sources.select(source, known.alias("collector")).withColumn("open", F.col("collector").isin(*available))
    joined = asked.join(results.select(source, F.col("success").alias("_success"), "found", "saved"), source, "left")
    reason = F.when(~F.col("open"), "collector_unavailable").when(F.col("_success").isNull(), "child_source_missing").when(~F.col("_success"), "source_failed")
    done = F.col("open") & F.coalesce("_success", F.lit(False))
    counts = [F.when(F.col("open"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("found", "saved")]
    return joined.select(source, "collector", done.alias("success"), reason.alias("reason"), *counts)


def cycle_summary(details: DataFrame) -> DataFrame:
    """One row of a collection cycle's sums and its success rate in percent."""
    n, ok = F.count("*"), F.count_if("success")
    return details.agg(
        n.alias("sources_processed"), ok.alias("sources_succeeded"), (n - ok).alias("sources_failed"), F.coalesce(F.sum("found"), F.lit(0)).alias("articles_found"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("articles_saved"), F.coalesce(F.round(F.try_divide(ok * 100.0, n), 2), F.lit(0.0)).alias("success_rate_percent"),
    )


def catalogue(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """A catalogue of sources (a dimension of bounded size) as a frame, with empty cache fields where there are none."""
    fields = "source_id string, name string, url string, category string, credibility_score double, update_frequency string, `_group` string, etag string, last_modified string"
    names = [x.strip().split(" ")[0].strip("`") for x in fields.split(",")]
    return spark.createDataFrame([(k, *(v.get(n) for n in names[1:])) for k, v in entries.items()], fields)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of a YAML file, found by its path in any store that Spark reads."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return catalogue(spark, yaml.safe_load(text[0]) or {} if text else {})


def group_buckets(sources: DataFrame, group: str = "_group") -> DataFrame:
    """source_id and bucket of the sources in the known groups."""
    return sources.where(F.col(group).isin(*GROUPS)).select("source_id", F.col(group).alias("bucket"))


def last_lines(log: DataFrame, order: str, limit: int, window: int = 200) -> DataFrame:
    """The last lines of a log, newest last: the last `window` are looked at, and of those that can be read `limit` stay."""
    tail = log.orderBy(F.desc(order)).limit(window).where("readable")
    return tail.orderBy(F.desc(order)).limit(limit)
