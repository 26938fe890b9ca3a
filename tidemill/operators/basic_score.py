"""The basic score: credibility, recency, content quality and engagement of an article from its fields, with an explanation.

Every part is a column expression over title and summary (null counts as empty), so a corpus is scored in one projection.
Keywords count as substrings of lower-case text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.keywords import Keywords
from tidemill.functions.text import contains_any, count_contained, let
from tidemill.operators.scoring import normalized, recency

#: Weights of the four parts, the least score that is included, and the words that count.
WEIGHTS = {"source_credibility": 0.1, "recency": 0.1, "content_quality": 0.4, "engagement_potential": 0.4}
INCLUDE = 0.3
JOURNALS = (
    (1.0, ("nature", "science", "cell", "new england journal of medicine", "lancet", "nejm", "pnas", "nature medicine", "nature genetics")),
    (0.8, ("plos one", "scientific reports", "nature communications", "journal of clinical investigation", "immunity", "neuron")),
    (0.6, ("journal of biological chemistry", "molecular cell", "cancer research", "blood", "diabetes")),
    (0.4, ("journal",)),
)
OTHER_JOURNAL = 0.2
CLICKBAIT = ("you won't believe", "shocking", "amazing", "incredible", "doctors hate", "secret", "miracle")
SOLID = ("study", "research", "analysis", "discovery", "investigation", "clinical trial", "peer-reviewed", "published")
TECHNICAL = (
    "molecule", "protein", "gene", "cell", "tissue", "organism", "hypothesis", "methodology", "statistical", "significant", "correlation", "analysis",
    "experiment", "treatment",
)
BOOST = (
    "breakthrough", "discovery", "research", "study", "clinical trial", "peer-reviewed", "published", "journal", "university", "scientists",
    "artificial intelligence", "machine learning", "climate change", "medical", "technology", "innovation", "nobel", "fda approved",
)
ENGAGING = ("breakthrough", "discovery", "first", "new", "revolutionary", "surprising", "unexpected", "major", "significant", "important")
TRENDING = (
    "artificial intelligence", "ai", "machine learning", "chatgpt", "climate change", "carbon", "renewable energy", "covid", "vaccine", "pandemic", "virus",
    "quantum", "crispr", "gene editing", "space", "mars", "webb telescope", "black hole",
)
JARGON = ("methodology", "statistical significance", "p-value", "multivariate analysis", "phenotype", "genotype", "chromatography", "spectroscopy", "phylogenetic")
WOW = (
    "first time", "never before", "unprecedented", "record", "largest", "smallest", "fastest", "slowest", "breakthrough", "revolutionary", "game-changing",
    "nobel", "award-winning", "world-class",
)
STRENGTHS = {"source_credibility": "Fuente muy confiable", "recency": "Muy reciente", "content_quality": "Contenido de alta calidad", "engagement_potential": "Alto potencial viral"}
WEAK = {
    "source_credibility": "Credibilidad de fuente limitada", "recency": "Contenido no muy reciente", "content_quality": "Calidad de contenido mejorable",
    "engagement_potential": "Potencial de engagement limitado",
}
#: What is looked for in whole texts, in one reading.
IN_TEXTS = Keywords(TECHNICAL, BOOST, TRENDING, JARGON, WOW)
WORD = r"[\p{L}\p{N}\p{M}_]+"


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def both(title: Column, summary: Column) -> Column:
    return F.lower(F.concat_ws(" ", filled(title), filled(summary)))


def points(condition: Column, value: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)


def journal_rank(journal: Column) -> Column:
    """1 to 0.2 by the first tier that the name holds a part of; 0 without a name."""
    low = F.lower(filled(journal))
    ranks = [F.when(contains_any(low, names), rank) for rank, names in JOURNALS]
    return F.when(low == "", 0.0).otherwise(F.coalesce(*ranks, F.lit(OTHER_JOURNAL)))


def credibility(reviewed: Column, preprint: Column, doi: Column, journal: Column) -> Column:
    status = F.when(F.coalesce(reviewed, F.lit(False)), 0.2).when(F.coalesce(preprint, F.lit(False)), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + status + points(filled(doi) != "", 0.1) + 0.1 * journal_rank(journal))


def dated_recency(age: Column, age_collected: Column) -> Column:
    """Recency of the date of publication, or four fifths of that of collection where it is unknown."""
    return clamp(F.when(age.isNull(), 0.8 * recency(age_collected)).otherwise(recency(age)))


def title_quality(title: Column) -> Column:
    low, n = F.lower(filled(title)), F.length(filled(title))
    total = 0.5 - 0.3 * count_contained(low, CLICKBAIT) + 0.1 * count_contained(low, SOLID)
    total = total + points(title.rlike("[0-9]"), 0.1) + points(low.rlike("university|institute|lab"), 0.1)
    total = total - F.when(n < 30, 0.2).when(n > 150, 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(clamp(total))


def text_quality(text: Column) -> Column:
    low = F.lower(filled(text))
    fresh = let(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)))
    total = 0.5 + F.least(F.lit(0.3), 0.6 * fresh) + F.least(F.lit(0.2), 0.05 * IN_TEXTS.count(IN_TEXTS.found(low), TECHNICAL))
    return F.when(F.length(low) < 50, 0.0).otherwise(clamp(total))


def content_quality(title: Column, summary: Column) -> Column:
    n = F.length(F.concat_ws(" ", filled(title), filled(summary)))
    long = F.when(n < 100, 0.2).when(n < 300, 0.6).when(n < 800, 1.0).when(n < 1500, 0.8).otherwise(0.5)
    keywords = F.least(F.lit(1.0), IN_TEXTS.count(IN_TEXTS.found(both(title, summary)), BOOST) / 5.0)
    return clamp(0.5 + 0.2 * long + 0.3 * title_quality(title) + 0.3 * text_quality(summary) + 0.2 * keywords)


def title_engagement(title: Column) -> Column:
    low = F.lower(filled(title))
    total = 0.5 + 0.1 * count_contained(low, ENGAGING) + points(title.rlike("[0-9]+%|[0-9]+ times|[0-9]+ years"), 0.1) + points(F.contains(title, F.lit("?")), 0.05)
    return F.when(low == "", 0.0).otherwise(clamp(total))


def engagement_potential(title: Column, summary: Column) -> Column:
    found = IN_TEXTS.found(both(title, summary))
    trend = F.least(F.lit(1.0), IN_TEXTS.count(found, TRENDING) / 3.0)
    plain = F.greatest(F.lit(0.3), 1 - 0.1 * IN_TEXTS.count(found, JARGON))
    wow = F.least(F.lit(1.0), IN_TEXTS.count(found, WOW) / 2.0)
    return clamp(0.5 + 0.4 * title_engagement(title) + 0.3 * trend + 0.2 * plain + 0.1 * wow)


def basic_score(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted parts, not rounded; weights that do not add up to 1 are scaled."""
    total = F.lit(0.0)
    for name, weight in normalized(weights or WEIGHTS).items():
        total = total + parts[name] * weight
    return clamp(total)


def assessment(score: Column) -> Column:
    return F.when(score >= 0.8, "excelente").when(score >= 0.6, "muy bueno").when(score >= 0.4, "bueno").when(score >= 0.2, "regular").otherwise("bajo")


def factors(title: Column, summary: Column, reviewed: Column, preprint: Column, doi: Column, journal: Column, age: Column) -> dict[str, Column]:
    """For each part of the score, the lines that explain it."""
    text, n = both(title, summary), F.length(F.concat_ws(" ", filled(title), filled(summary)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    days = F.floor(age / 24)
    dated = F.when(age.isNull(), "Fecha de publicación desconocida (-)").when(days == 0, "Publicado hoy (+)")
    for limit, sign in ((3, " (+)"), (7, ""), (None, " (-)")):
        line = F.concat(F.lit("Publicado hace "), days.cast("string"), F.lit(f" días{sign}"))
        dated = dated.when(days <= limit, line) if limit else dated.otherwise(line)
    return {
        "source_credibility": F.array_compact(F.array(
            F.when(yes(reviewed), "Artículo peer-reviewed (+)").when(yes(preprint), "Preprint sin peer review (-)"),
            F.when(filled(doi) != "", "Tiene DOI (+)"), F.when(filled(journal) != "", F.concat(F.lit("Publicado en "), journal)),
        )),
        "recency": F.array(dated),
        "content_quality": F.array_compact(F.array(
            F.when(n >= 300, "Longitud de contenido apropiada (+)").otherwise("Contenido relativamente corto (-)"),
            F.when(F.length(filled(title)) > 30, "Título descriptivo (+)"),
        )),
        "engagement_potential": F.array_compact(F.array(
            F.when(contains_any(text, ("breakthrough", "discovery", "first")), "Contiene palabras de impacto (+)"),
            F.when(contains_any(text, ("ai", "climate", "covid")), "Trata temas trending (+)"),
        )),
    }


def explanation(score: Column, parts: dict[str, Column], lines: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The explanation of a score as one struct: assessment, each part with weight, contribution and lines, strengths, weak points, advice."""
    weigh = normalized(weights or WEIGHTS)
    part = lambda k: F.struct(parts[k].alias("score"), F.lit(weigh[k]).alias("weight"), (parts[k] * weigh[k]).alias("contribution"), lines[k].alias("factors"))
    return F.struct(
        assessment(score).alias("overall_assessment"), F.struct(*[part(k).alias(k) for k in weigh]).alias("component_breakdown"),
        F.array_compact(F.array(*[F.when(parts[k] >= 0.8, STRENGTHS[k]) for k in weigh])).alias("key_strengths"),
        F.array_compact(F.array(*[F.when(parts[k] < 0.4, WEAK[k]) for k in weigh])).alias("improvement_areas"),
        F.when(score >= INCLUDE, "include").otherwise("exclude").alias("recommendation"),
    )
