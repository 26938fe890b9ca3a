"""Scores of articles as column arithmetic; the clock is always a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.keywords import Keywords
from tidemill.functions.lexicons import LATAM, LOW_VALUE, SCIENCE, TECH
from tidemill.functions.text import WOW, contains_any, count_contained, data_density, let

#: Weights, half-life and limits of the feature score.
WEIGHTS = {"source": 0.15, "freshness": 0.20, "content": 0.35, "engagement": 0.30}
SOURCE, HALF_LIFE_H, OLDEST_H, INCLUDE = 0.5, 18.0, 168.0, 0.3
IN_TEXTS = Keywords(WOW, LOW_VALUE, LATAM)
SENTIMENT = {"positive": 0.7, "negative": 0.6, "neutral": 0.5}


def age_hours(published: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(published)) / F.lit(3_600_000_000.0)


def freshness(age: Column) -> Column:
    """1 for new, 0 from OLDEST_H on, halved each HALF_LIFE_H; 0.5 if unknown."""
    return F.when(age.isNull(), 0.5).when(age <= 0, 1.0).when(age >= OLDEST_H, 0.0).otherwise(F.exp(-math.log(2) * age / HALF_LIFE_H))


def recency(age: Column) -> Column:
    """The piecewise recency of the basic score."""
    return (
        F.when(age <= 1, 1.0).when(age <= 24, 0.9 + 0.1 * F.exp(-(age - 1) / 8.0)).when(age <= 168, 0.7 * F.exp(-(age - 24) / 48.0))
        .when(age < 720, 0.7 * math.exp(-3.0) * (720 - age) / 552.0).otherwise(0.0)
    )


def content(title: Column, summary: Column, entities: Column) -> Column:
    return (
        0.4 * F.least(F.length(F.coalesce(title, F.lit(""))) / 120.0, F.lit(1.0))
        + 0.4 * F.least(F.length(F.coalesce(summary, F.lit(""))) / 400.0, F.lit(1.0))
        + 0.2 * F.least(entities / 5.0, F.lit(1.0))
    )


def engagement(sentiment: Column, words: Column) -> Column:
    """Words of 0 or null count as 400."""
    mood = F.when(sentiment == "positive", SENTIMENT["positive"]).when(sentiment == "negative", SENTIMENT["negative"]).otherwise(SENTIMENT["neutral"])
    known = F.when(F.coalesce(words, F.lit(0)) == 0, 400).otherwise(words)
    return 0.6 * mood + 0.4 * F.least(known / 800.0, F.lit(1.0))


def diversity_penalty(duplicate: Column) -> Column:
    return F.least(0.15 * F.coalesce(duplicate, F.lit(0.0)), F.lit(0.3))


def feature_score(fresh: Column, good: Column, engaging: Column, penalty: Column) -> Column:
    total = WEIGHTS["source"] * SOURCE + WEIGHTS["freshness"] * fresh + WEIGHTS["content"] * good + WEIGHTS["engagement"] * engaging - penalty
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Weights that add up to 1, if they do not nearly do so."""
    total = sum(weights.values())
    return weights if abs(total - 1) <= 0.01 else {k: v / total for k, v in weights.items()}


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").when(score >= 0.2, "weak").otherwise("poor")


def audience_score(title: Column, summary: Column, source: Column) -> Column:
    """How well a candidate suits a Latin American audience of public-interest science."""
    title, summary = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    text = F.lower(F.concat_ws(" ", title, summary, F.coalesce(source, F.lit(""))))
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    return (
        4.0 * count_contained(text, LATAM) + 2.5 * count_contained(text, SCIENCE) - 3.5 * count_contained(text, LOW_VALUE)
        + F.least(F.length(summary) / 140.0, F.lit(1.5)) + F.least(F.length(title) / 80.0, F.lit(0.5))
        + yes(contains_any(text, ("study", "research", "scientists", "data")), 1.0) + yes(contains_any(text, TECH), 1.5) - yes(contains_any(text, ("partnership", "portal")), 1.0)
    )


def heuristic_quality(text: Column) -> Column:
    """Substance, narrative, relevance and credibility of a text from surface signs, rounded to four places."""
    sentences = F.filter(F.split(text, r"\."), lambda x: F.length(F.trim(x)) > 10)
    words = lambda found: F.aggregate(found, F.lit(0), lambda a, x: a + F.size(F.split(F.trim(x), r"\s+")))
    mean = let(sentences, lambda found: words(found) / F.greatest(F.lit(1), F.size(found)))
    flow = let(mean, lambda x: F.when(x.between(15, 25), 1.0).otherwise(0.5))
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    credible = 0.5 + yes(contains_any(text, ('"', "“")), 0.2) + yes(contains_any(text, ("<p>", "\n\n")), 0.2) + yes(F.contains(text, F.lit("http")), 0.1)
    found = IN_TEXTS.found(F.lower(text))
    narrative = 0.6 * F.least(F.lit(1.0), IN_TEXTS.count(found, WOW) / 4.0) + 0.4 * F.least(F.lit(1.0), F.length(text) / 2000)
    latam = F.when(IN_TEXTS.count(found, LOW_VALUE) > 0, 0.0).when(IN_TEXTS.count(found, LATAM) > 0, 1.0).otherwise(0.0)
    total = 0.35 * data_density(text) + 0.30 * narrative + 0.20 * F.greatest(latam, 0.5 * flow) + 0.15 * credible
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def cognitive_blend(
    text: Column, source: Column, fresh: Column, dims: dict[str, Column], heuristic: Column, weights: dict[str, float]
) -> dict[str, Column]:
    """Parts, score, label and inclusion from given dimensions (0 to 5), or the heuristic quality where there are none.

    text is title, summary and content in lower case. Low-value words without the audience's own words take all
    relevance; those words add 0.2. Irrelevant articles stay below inclusion. Parts and score are rounded to 4 places.
    """
    rated = dims["substance"].isNotNull()
    own = {k: F.when(rated, F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0)) / 5.0)).otherwise(heuristic) for k, v in dims.items()}
    latam, low = contains_any(text, LATAM), contains_any(text, LOW_VALUE)
    own["relevance"] = F.when(low & ~latam, 0.0).when(latam, F.least(F.lit(1.0), own["relevance"] + 0.2)).otherwise(own["relevance"])
    parts = {
        "content_quality": own["substance"], "engagement_potential": own["narrative"], "recency": fresh * 0.5 + own["relevance"] * 0.5,
        "source_credibility": source * 0.5 + own["credibility"] * 0.5,
    }
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))))
    total = F.when(own["relevance"] < 0.4, F.least(total, F.lit(0.55))).otherwise(total)
    out = {k: F.round(v, 4) for k, v in parts.items()} | {f"nqi_{k}": F.round(v, 4) for k, v in own.items()}
    label = F.when(total >= 0.75, "priority").when(total >= 0.60, "publishable").otherwise("discard")
    return out | {"final_score": F.round(total, 4), "decision_label": label, "should_include": total >= 0.60}


def persist_scores(articles: DataFrame, log: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(articles with the fresh values of columns, the log with the fresh rows appended)."""
    news = fresh.select(key, F.lit(True).alias("_fresh"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = articles.join(news, key, "left")
    updated = [F.when(F.col("_fresh"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in articles.columns]
    return joined.select(*updated), log.unionByName(fresh)


SCORERS = ("cognitive", "basic", "feature")


def scorer_of(mode: str | None) -> str:
    """The scorer of a configured mode; feature unless it is one of the others."""
    return mode if mode in SCORERS else "feature"
