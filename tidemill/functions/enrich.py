"""Enrichment of articles in column expressions: entities, topics, moods, dates with their zones, tags, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import topics as W
from tidemill.functions.html import normalized_html
from tidemill.functions.text import detect_language, fold_accents, let

#: Fixed value: the version of the lexicons that a record names.
MODEL_VERSION = "2025.02-pattern-v1"
STAMP = "struct<utc:timestamp,offset_minutes:int,zone:string>"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Zones of mail dates by name, in minutes east of Greenwich.
ZONES = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0, "at": -240, "ast": -240, "adt": -180, "et": -300, "est": -300, "edt": -240, "ct": -360, "cst": -360, "cdt": -300,
    "mt": -420, "mst": -420, "mdt": -360, "pt": -480, "pst": -480, "pdt": -420, "a": -60, "n": 60, "m": -720, "y": 720,
}
#: Lengths that tags may have, and their letters.
LEAST_TAG, MOST_TAG, MOST_TAGS = 3, 40, 8
TAG = r"^[a-z0-9áéíóúüñ\s]+$"


def lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def resolve_language(given: Column, text: Column) -> Column:
    """The given language if it is supported; without one, that of the text; else English."""
    known = F.coalesce(F.when(F.trim(given) != "", F.lower(given)), detect_language(text))
    return F.when(known.isin(*W.LANGUAGES), known).otherwise("en")


def by_language(language: Column, made) -> Column:
    """The value that made(language) gives for each supported language."""
    out = F.when(language == W.LANGUAGES[0], made(W.LANGUAGES[0]))
    for name in W.LANGUAGES[1:]:
        out = out.when(language == name, made(name))
    return out


def _lists() -> list[tuple[str, ...]]:
    moods = [w[n] for w in (W.POSITIVE, W.NEGATIVE) for n in w]
    return [k[n] for k in W.TOPICS.values() for n in k] + moods


#: All keywords once: single words and phrases.
SINGLE = tuple(dict.fromkeys(w for words in _lists() for w in words if " " not in w))
PHRASES = tuple(dict.fromkeys(w for words in _lists() for w in words if " " in w))


def analysed(text: Column, language: Column, made) -> Column:
    """made(x) of a text's reading x: language, text, folded (lower case without accents) and found, the keywords in it.

    The text is lowered, folded and parted into words once; what the lists ask of it is then a matter of few keywords.
    """
    literals = lambda words: F.array(*map(F.lit, words))

    def read(x: Column) -> Column:
        singles = F.array_intersect(F.split(x["low"], r"(?U)\W+"), literals(SINGLE))
        phrases = F.filter(literals(PHRASES), lambda p: F.contains(x["low"], p))
        return F.struct(x["language"].alias("language"), x["text"].alias("text"), fold_accents(x["low"]).alias("folded"), F.concat(singles, phrases).alias("found"))

    first = F.struct(language.alias("language"), F.coalesce(text, F.lit("")).alias("text"), lower(text).alias("low"))
    return let(first, lambda x: let(read(x), made))


def _count(x: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(x["found"], F.array(*map(F.lit, dict.fromkeys(words)))))


def topics_in(x: Column, most: int = 5) -> Column:
    found = F.array_compact(F.array(*[F.when(by_language(x["language"], lambda n, k=k: _count(x, k["shared"] + k[n]) > 0), F.lit(topic)) for topic, k in W.TOPICS.items()]))
    return let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit("general"))).otherwise(F.slice(f, 1, most)))


def sentiment_in(x: Column, tie: str = "neutral", default: str = "neutral") -> Column:
    up, down = (by_language(x["language"], lambda n, w=w: _count(x, w["shared"] + w[n])) for w in (W.POSITIVE, W.NEGATIVE))
    told = lambda c: F.when(c["up"] > c["down"], "positive").when(c["down"] > c["up"], "negative").when(c["up"] + c["down"] > 0, tie).otherwise(default)
    return let(F.struct(up.alias("up"), down.alias("down")), told)


def entities_in(x: Column) -> Column:
    def places(name: str) -> Column:
        found = []
        for order, (pattern, exact) in enumerate(W.ENTITIES["shared"] + W.ENTITIES[name]):
            at = F.instr(x["text"], F.lit(pattern)) if exact else F.instr(x["folded"], fold_accents(F.lower(F.lit(pattern))))
            found.append(F.struct(at.alias("at"), F.lit(order).alias("k"), F.lit(pattern).alias("name")))
        return F.array_distinct(F.transform(F.array_sort(F.filter(F.array(*found), lambda e: e["at"] > 0)), lambda e: e["name"]))

    return by_language(x["language"], places)


def topics(text: Column, language: Column, most: int = 5) -> Column:
    """Topics with a keyword of their own or of the language, in the order of the list; `general` if none."""
    return analysed(text, language, lambda x: topics_in(x, most))


def sentiment(text: Column, language: Column, tie: str = "neutral", default: str = "neutral") -> Column:
    """positive or negative by distinct words; a tie of some hits is `tie`, no hit `default`."""
    return analysed(text, language, lambda x: sentiment_in(x, tie, default))


def entities(text: Column, language: Column) -> Column:
    """Names in the order of their first places; case and accents count only for names that say so."""
    return analysed(text, language, entities_in)


def enrichment(title: Column, summary: Column, content: Column, language: Column) -> Column:
    """language, normalized_title, normalized_summary, entities, topics, sentiment and model_version of an article, as one
    struct. The summary counts before the content; keywords are looked for in the normalized texts, then in those given."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    body = F.when(filled(summary) != "", summary).otherwise(filled(content))
    head, rest = normalized_html(filled(title)), normalized_html(body)
    parts = F.filter(F.array(F.trim(F.concat_ws(" ", head, rest)), filled(title), filled(summary), filled(content)), lambda p: p != "")
    tongue = resolve_language(language, F.concat_ws(" ", filled(title), filled(summary)))
    # the record is made inside the reading, with the two texts that it keeps
    kept = F.struct(head.alias("head"), rest.alias("rest"), F.array_join(parts, " ").alias("text"), tongue.alias("language"))

    def record(k: Column) -> Column:
        return analysed(k["text"], k["language"], lambda x: F.struct(
            x["language"].alias("language"), k["head"].alias("normalized_title"), k["rest"].alias("normalized_summary"), entities_in(x).alias("entities"),
            topics_in(x).alias("topics"), sentiment_in(x).alias("sentiment"), F.lit(MODEL_VERSION).alias("model_version"),
        ))

    return let(kept, record)


def parse_stamp(text: Column) -> Column:
    """(utc, offset_minutes, zone) of a date of a feed: RFC 822 or ISO 8601; no zone is UTC; null if it is neither.

    A null is never taken for now. The zone of an offset is named by it, as UTC+02:00, and so is one that mail knows by
    name (EST, PDT). The time of any other name is read as UTC, but the zone has that name, so it does not pass for UTC.
    """
    value = F.trim(text)
    mail = r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([+-]\d{2}:?\d{2}|[a-z]{1,5})?$"
    iso = r"(?i)^(\d{4})-(\d{2})-(\d{2})(?:[t ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?$"
    part = lambda pattern, i: F.regexp_extract(value, pattern, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(mail, 2))).cast("int")
    is_mail, is_iso = value.rlike(mail), value.rlike(iso)
    day = F.when(is_mail & (month > 0), F.format_string("%s-%02d-%s", part(mail, 3), month, F.lpad(part(mail, 1), 2, "0"))).when(is_iso, F.format_string("%s-%s-%s", part(iso, 1), part(iso, 2), part(iso, 3)))
    clock = F.when(is_mail, F.lpad(part(mail, 4), F.when(F.length(part(mail, 4)) > 5, 8).otherwise(5), F.lit("0"))).otherwise(part(iso, 4))
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    zone = F.replace(F.when(is_mail, part(mail, 5)).otherwise(part(iso, 5)), F.lit(":"), F.lit(""))
    signed = zone.rlike(r"^[+-]\d{4}$")
    minutes = F.when(signed, F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")).otherwise(0)
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.lower(zone)]
    offset = F.when(signed, F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes)).otherwise(F.coalesce(named, F.lit(0)))
    local = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    utc = F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60_000_000)
    shown = F.concat(F.when(offset < 0, "UTC-").otherwise("UTC+"), F.lpad(F.floor(F.abs(offset) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(offset) % 60).cast("string"), 2, "0"))
    unknown = (zone != "") & ~signed & named.isNull()
    name = F.when(unknown, F.upper(zone)).when(offset == 0, "UTC").otherwise(shown)
    return F.when(day.isNotNull() & utc.isNotNull(), F.struct(utc.alias("utc"), offset.alias("offset_minutes"), name.alias("zone")))


def display_time(utc: Column, zone: str = "America/Santiago") -> Column:
    """A time as it is shown in a zone, with the offset as name and as number: 2024-01-05 09:00:00 -03-0300."""
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(utc)) / 60_000_000).cast("int")
    sign, size = F.when(minutes < 0, "-").otherwise("+"), F.abs(minutes)
    hours, rest = F.floor(size / 60).cast("int"), size % 60
    short = F.when(rest == 0, F.format_string("%02d", hours)).otherwise(F.format_string("%02d%02d", hours, rest))
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss "), sign, short, sign, F.format_string("%02d%02d", hours, rest))


def article_topics(metadata: Column, keywords: Column) -> Column:
    """The topics in an article's metadata (JSON), else its keywords, else none."""
    held = F.from_json(F.get_json_object(metadata, "$.enrichment.topics"), "array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.size(held) > 0, held), F.when(F.size(keywords) > 0, keywords), none)


def basic_tag(tag: Column) -> Column:
    """A tag in lower case without dots, dashes and underscores as single spaces."""
    return F.regexp_replace(F.replace(F.regexp_replace(F.lower(F.trim(tag)), "[-_]", " "), F.lit("."), F.lit("")), r"(?U)\s+", " ")


def sanitize_tags(tags: Column, stop: tuple[str, ...] = (), spelling: dict[str, str] | None = None, alias: dict[str, str] | None = None, short: tuple[str, ...] = ()) -> Column:
    """(tags, removed, replaced, merged, warnings) of a list of tags.

    Tags are cleaned; empty and stop tags go; spelling, then aliases are put right; of tags that differ by accents only
    the first stays; too short and too long ones go; at most MOST_TAGS stay.
    """
    text = "array<string>"
    stops, known_short = F.array(*map(F.lit, stop)).cast(text), F.array(*map(F.lit, short)).cast(text)
    look = lambda names, t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), t), t) if names else t
    cleaned = F.transform(F.coalesce(tags, F.array().cast(text)), lambda t: F.struct(t.alias("given"), basic_tag(F.coalesce(t, F.lit(""))).alias("tag")))
    gone = lambda x: (x["tag"] == "") | F.array_contains(stops, x["tag"])
    kept = F.filter(cleaned, lambda x: ~gone(x))
    spelt = F.transform(kept, lambda x: F.struct(x["tag"].alias("a"), look(spelling, x["tag"]).alias("b"), look(alias, look(spelling, x["tag"])).alias("c")))
    final = F.transform(spelt, lambda x: x["c"])
    folded = F.transform(final, fold_accents)
    first = F.filter(final, lambda t, i: F.array_position(folded, fold_accents(t)) == i + 1)
    size_ok = lambda t: ((F.length(t) >= LEAST_TAG) | F.array_contains(known_short, t)) & (F.length(t) <= MOST_TAG)
    fit = F.filter(first, size_ok)
    removed = F.concat(
        F.transform(F.filter(cleaned, gone), lambda x: F.when(x["tag"] == "", F.coalesce(x["given"], F.lit(""))).otherwise(x["tag"])), F.filter(first, lambda t: ~size_ok(t))
    )
    replaced = F.flatten(F.transform(spelt, lambda x: F.array_compact(F.array(F.when(x["a"] != x["b"], F.concat_ws(">", x["a"], x["b"])), F.when(x["b"] != x["c"], F.concat_ws(">", x["b"], x["c"]))))))
    merged = F.filter(F.transform(final, lambda t, i: F.when(F.array_position(folded, fold_accents(t)) <= i, F.concat_ws(">", F.get(final, (F.array_position(folded, fold_accents(t)) - 1).cast("int")), t))),
                      lambda m: m.isNotNull() & (F.substring_index(m, ">", 1) != F.substring_index(m, ">", -1)))
    warnings = F.concat(
        F.transform(F.filter(cleaned, lambda x: F.array_contains(stops, x["tag"])), lambda x: F.concat(F.lit("removed stop tag: "), x["tag"])),
        F.transform(F.filter(first, lambda t: ~size_ok(t)), lambda t: F.concat(F.when(F.length(t) > MOST_TAG, "removed long tag: ").otherwise("removed short tag: "), t)),
        F.when(F.size(fit) > MOST_TAGS, F.array(F.lit(f"truncated tags to max {MOST_TAGS}"))).otherwise(F.array().cast(text)),
    )
    return F.struct(F.slice(fit, 1, MOST_TAGS).alias("tags"), removed.alias("removed"), replaced.alias("replaced"), merged.alias("merged"), warnings.alias("warnings"))


def validate_tags(tags: Column, stop: tuple[str, ...] = (), short: tuple[str, ...] = ()) -> Column:
    """(is_valid, needs_review, errors, warnings) of a list of clean tags."""
    text = "array<string>"
    stops, known_short = F.array(*map(F.lit, stop)).cast(text), F.array(*map(F.lit, short)).cast(text)
    quoted = lambda start, t: F.concat(F.lit(start), t, F.lit("'"))
    errors = F.flatten(F.transform(tags, lambda t: F.array_compact(F.array(
        F.when(~t.rlike(TAG), quoted("Invalid characters in tag: '", t)), F.when(F.array_contains(stops, t), quoted("Forbidden stop tag found: '", t)),
        F.when((F.length(t) < LEAST_TAG) & ~F.array_contains(known_short, t), quoted("Tag too short: '", t)), F.when(F.length(t) > MOST_TAG, quoted("Tag too long: '", t)),
    ))))
    warnings = F.when(F.size(tags) > MOST_TAGS, F.array(F.format_string(f"Tag count (%d) exceeds limit ({MOST_TAGS})", F.size(tags)))).otherwise(F.array().cast(text))
    review = F.exists(tags, lambda t: ~t.rlike(TAG) | F.array_contains(stops, t))
    return F.struct((F.size(errors) == 0).alias("is_valid"), review.alias("needs_review"), errors.alias("errors"), warnings.alias("warnings"))
