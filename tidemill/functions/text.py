"""Column functions over text: cleaning, language, keywords, sentiment, slugs, counts and failure classes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words that tell the two detected languages apart.
STOP_WORDS = {
    "es": ("de", "la", "el", "y", "que", "en", "los", "para", "con", "las", "del", "se", "un", "una"),
    "en": ("the", "and", "of", "to", "in", "for", "on", "with", "as", "is", "that", "this"),
}
#: Ordered classes of failures and the substrings that name them ("js" also names json).
FAILURES = (
    ("publication_contract_failure", ("permalink", "frontmatter", "validate:content")),
    ("editorial_relevance_rejection", ("relevance", "editorial", "auditor", "critic")),
    ("anti_bot_block", ("cloudflare", "captcha", "anti-bot")),
    ("js_render_required", ("js", "javascript", "render", "hydration", "headless_disabled")),
    ("article_fetch_blocked", ("403", "401", "429", "forbidden", "blocked")),
    ("content_too_short", ("content_too_short", "min_length", "too short")),
    ("extraction_parser_mismatch", ("parse", "extract", "selector")),
)
#: Ordered classes of log messages and the substrings that name them.
LOG_CLASSES = (
    ("Lifecycle", ("cycle", "starting", "finished")),
    ("Collection", ("fetch", "rss", "source", "collect")),
    ("Scoring", ("score", "rank", "scoring")),
    ("Publishing", ("publish", "github", "pr")),
    ("Storage", ("db", "database")),
    ("System Error", ("error", "fail")),
)
#: Words of surprise.
WOW = ("breakthrough", "discovery", "first", "new", "revolutionary", "unexpected", "major", "significant", "study", "research", "evidence", "found", "identified", "milestone", "record")
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value computed once, however often made uses it: branches and long sums would compute it anew."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\x0B\f]+", " "))


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def slugify(text: Column, fallback: str = "untitled") -> Column:
    dashed = F.regexp_replace(fold_accents(F.trim(text)), r"[^a-zA-Z0-9\-_]+", "-")
    slug = F.lower(F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", ""))
    return F.when(slug == "", fallback).otherwise(slug)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n\x0B\f]+"))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 200))


def has_word(text: Column, word: str) -> Column:
    """A phrase anywhere, a single word between word borders; text is lower case already."""
    return F.contains(text, F.lit(word)) if " " in word else text.rlike(rf"(?U)\b{word}\b")


def tokens_of(text: Column) -> Column:
    """The distinct runs of word characters of a text; a word stands between word borders exactly if it is one of them."""
    return F.array_distinct(F.split(text, r"(?U)\W+"))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur: single words as tokens, in one pass over the text, phrases anywhere."""
    single = [w for w in dict.fromkeys(words) if " " not in w]
    phrases = [w for w in dict.fromkeys(words) if " " in w]
    found = F.size(F.array_intersect(tokens_of(text), F.array(*[F.lit(w) for w in single]))) if single else F.lit(0)
    return reduce(lambda a, w: a + F.contains(text, F.lit(w)).cast("int"), phrases, found)


def detect_language(text: Column) -> Column:
    """en or es by distinct stop words; a tie goes to es only if letters of Spanish occur."""

    def told(x: Column) -> Column:
        en, es = (F.size(F.array_intersect(x["words"], F.array(*map(F.lit, STOP_WORDS[n])))) for n in ("en", "es"))
        return F.when(es > en, "es").when(en > es, "en").when(x["low"].rlike("[áéíóúñ]"), "es").otherwise("en")

    every = F.array(*map(F.lit, dict.fromkeys(STOP_WORDS["en"] + STOP_WORDS["es"])))
    words = lambda low: F.struct(low.alias("low"), F.array_intersect(F.split(low, r"(?U)\W+"), every).alias("words"))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(words(low), told))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def count_contained(text: Column, parts: tuple[str, ...]) -> Column:
    """How many of the parts occur, as substrings."""
    return let(text, lambda t: reduce(lambda a, b: a + b, [F.contains(t, F.lit(p)).cast("int") for p in parts]))


def first_class(text: Column, classes: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first class one of whose substrings occurs, or null."""
    return F.coalesce(*[F.when(contains_any(text, parts), F.lit(name)) for name, parts in classes])


def failure_class(message: Column, saved: Column, feed_ok: Column) -> Column:
    """The class of a source's failure; null where it saved articles and nothing is reported."""
    low = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    found = F.coalesce(first_class(low, FAILURES), F.when(~feed_ok, "feed_fetch_failure"), F.when(low != "", "unknown_failure"))
    return F.when((saved > 0) & (low == ""), F.lit(None)).otherwise(found)


def log_class(message: Column) -> Column:
    return F.coalesce(first_class(F.lower(message), LOG_CLASSES), F.lit("System"))


def data_density(text: Column) -> Column:
    """Years, percentages, numbers and (twice) statistical notation for each word; 2 in 100 counts as 1."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    points = n(r"\b(19|20)\d{2}\b") + n(r"\d+(\.\d+)?%") + 2 * n(r"(?i)n\s*=|p\s*[<>=]|×10") + n(r"\b\d{2,}\b")
    return let(word_count(text), lambda words: F.when(words == 0, 0.0).otherwise(F.least(F.lit(1.0), points / words / 0.02)))
