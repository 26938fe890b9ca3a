"""Queries of the basic score, its explanation, the cognitive blend, score logs and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import lexicons as L
from tidemill.operators import basic_score as B
from tidemill.operators import ranking, scoring, selection
from tidemill.plans.bindings import ARTICLES, articles, table
from tidemill.plans.registry import any_sql, capped_sql, count_sql, query

#: Articles with the fields of the basic score; content stands in for the summary, and ids decide the rest.
SCORED = rf"""{ARTICLES}, scored AS (
  SELECT id, source, title, content, score, id % 5 = 0 AS reviewed, id % 7 = 0 AS preprint, CASE WHEN id % 3 = 0 THEN '10.1000/x' ELSE '' END AS doi,
         CASE id % 6 WHEN 0 THEN 'Nature Physics' WHEN 1 THEN 'PLOS ONE' WHEN 2 THEN 'Cancer Research' WHEN 3 THEN 'The Journal of Things' WHEN 4 THEN 'Acta' ELSE NULL END AS journal,
         CASE WHEN id % 11 = 0 THEN NULL ELSE (id % 900) * 1.0::DOUBLE END AS age, (id % 400) * 1.0::DOUBLE AS age_collected FROM articles)"""
JOURNALS = {0: "Nature Physics", 1: "PLOS ONE", 2: "Cancer Research", 3: "The Journal of Things", 4: "Acta"}


def scored(spark, d) -> DataFrame:
    i = F.col("id")
    journal = F.element_at(F.create_map(*[F.lit(x) for pair in JOURNALS.items() for x in pair]), (i % 6).cast("int"))
    return articles(spark, d).select(
        "id", "source", "title", "content", "score", (i % 5 == 0).alias("reviewed"), (i % 7 == 0).alias("preprint"), F.when(i % 3 == 0, "10.1000/x").otherwise("").alias("doi"),
        journal.alias("journal"), F.when(i % 11 != 0, (i % 900).cast("double")).alias("age"), (i % 400).cast("double").alias("age_collected"),
    )


def parts() -> dict:
    t, s = F.col("title"), F.col("content")
    return {
        "source_credibility": B.credibility(F.col("reviewed"), F.col("preprint"), F.col("doi"), F.col("journal")), "recency": B.dated_recency(F.col("age"), F.col("age_collected")),
        "content_quality": B.content_quality(t, s), "engagement_potential": B.engagement_potential(t, s),
    }


def recency_sql(age: str) -> str:
    return (
        f"(CASE WHEN {age} <= 1 THEN 1.0::DOUBLE WHEN {age} <= 24 THEN 0.9::DOUBLE + 0.1::DOUBLE * exp(-({age} - 1) / 8) WHEN {age} <= 168 THEN 0.7::DOUBLE * exp(-({age} - 24) / 48)"
        f" WHEN {age} < 720 THEN 0.7::DOUBLE * exp(-3.0::DOUBLE) * (720 - {age}) / 552 ELSE 0.0::DOUBLE END)"
    )


TIERS = " ".join(f"WHEN {any_sql('lower(journal)', names)} THEN {rank}::DOUBLE" for rank, names in B.JOURNALS)
CREDIBILITY = f"""least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN reviewed THEN 0.2::DOUBLE WHEN preprint THEN 0.1 ELSE 0 END + CASE WHEN doi <> '' THEN 0.1::DOUBLE ELSE 0 END
  + 0.1::DOUBLE * CASE WHEN coalesce(journal, '') = '' THEN 0::DOUBLE {TIERS} ELSE 0.2::DOUBLE END)"""
RECENCY = f"least(1.0::DOUBLE, CASE WHEN age IS NULL THEN 0.8::DOUBLE * {recency_sql('age_collected')} ELSE {recency_sql('age')} END)"
WORDS = rf"regexp_extract_all(lower(coalesce(content, '')), '{B.WORD}')"
BOTH = "lower(coalesce(title, '') || ' ' || coalesce(content, ''))"
TITLE = f"""CASE WHEN coalesce(title, '') = '' THEN 0::DOUBLE ELSE greatest(0, least(1, 0.5::DOUBLE - 0.3::DOUBLE * ({count_sql("lower(title)", B.CLICKBAIT)}) + 0.1::DOUBLE * ({count_sql("lower(title)", B.SOLID)})
  + CASE WHEN regexp_matches(title, '[0-9]') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(title), 'university|institute|lab') THEN 0.1::DOUBLE ELSE 0 END
  - CASE WHEN length(title) < 30 THEN 0.2::DOUBLE WHEN length(title) > 150 THEN 0.1 ELSE 0 END)) END"""
TEXT = f"""CASE WHEN length(coalesce(content, '')) < 50 THEN 0::DOUBLE ELSE greatest(0, least(1, 0.5::DOUBLE + least(0.3::DOUBLE, 0.6::DOUBLE * coalesce(len(list_distinct({WORDS})) / nullif(len({WORDS}), 0)::DOUBLE, 0))
  + least(0.2::DOUBLE, 0.05::DOUBLE * ({count_sql("lower(content)", B.TECHNICAL)})))) END"""
LONG = "(CASE WHEN n < 100 THEN 0.2::DOUBLE WHEN n < 300 THEN 0.6 WHEN n < 800 THEN 1.0 WHEN n < 1500 THEN 0.8 ELSE 0.5 END)"
CONTENT = f"greatest(0, least(1, 0.5::DOUBLE + 0.2::DOUBLE * {LONG} + 0.3::DOUBLE * title_part + 0.3::DOUBLE * text_part + 0.2::DOUBLE * least(1.0::DOUBLE, boosts / 5.0::DOUBLE)))"
TITLE_PULL = f"""CASE WHEN coalesce(title, '') = '' THEN 0::DOUBLE ELSE greatest(0, least(1, 0.5::DOUBLE + 0.1::DOUBLE * ({count_sql("lower(title)", B.ENGAGING)})
  + CASE WHEN regexp_matches(title, '[0-9]+%|[0-9]+ times|[0-9]+ years') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(title, '?') THEN 0.05::DOUBLE ELSE 0 END)) END"""
PULL = """greatest(0, least(1, 0.5::DOUBLE + 0.4::DOUBLE * title_pull + 0.3::DOUBLE * least(1.0::DOUBLE, trends / 3.0::DOUBLE) + 0.2::DOUBLE * greatest(0.3::DOUBLE, 1 - 0.1::DOUBLE * jargon)
  + 0.1::DOUBLE * least(1.0::DOUBLE, wows / 2.0::DOUBLE)))"""
PARTS = f"""{SCORED}, signs AS (
  SELECT *, {BOTH} AS t, length(coalesce(title, '') || ' ' || coalesce(content, '')) AS n, {TITLE} AS title_part, {TEXT} AS text_part, {TITLE_PULL} AS title_pull FROM scored),
counted AS (SELECT *, {count_sql("t", B.BOOST)} AS boosts, {count_sql("t", B.TRENDING)} AS trends, {count_sql("t", B.JARGON)} AS jargon, {count_sql("t", B.WOW)} AS wows FROM signs),
parts AS (SELECT *, {CREDIBILITY} AS source_credibility, {RECENCY} AS recency, {CONTENT} AS content_quality, {PULL} AS engagement_potential FROM counted),
whole AS (SELECT *, greatest(0, least(1, source_credibility * 0.1::DOUBLE + recency * 0.1::DOUBLE + content_quality * 0.4::DOUBLE + engagement_potential * 0.4::DOUBLE)) AS final FROM parts)"""


@query(f"WITH {PARTS} SELECT id, round(final, 6) AS final_score, final >= 0.3 AS should_include FROM whole")
def c6_basic_score(spark, d):
    total = B.basic_score(parts())
    return scored(spark, d).select("id", total.alias("s")).select("id", F.round("s", 6).alias("final_score"), (F.col("s") >= B.INCLUDE).alias("should_include"))


@query(f"WITH {PARTS} SELECT id, round(source_credibility, 6) AS source_credibility, round(recency, 6) AS recency FROM whole")
def c7_credibility(spark, d):
    p = parts()
    return scored(spark, d).select("id", F.round(p["source_credibility"], 6).alias("source_credibility"), F.round(p["recency"], 6).alias("recency"))


@query(f"WITH {PARTS} SELECT id, round(content_quality, 6) AS content_quality, round(title_part, 6) AS title_quality FROM whole")
def c9_content_quality(spark, d):
    return scored(spark, d).select("id", F.round(parts()["content_quality"], 6).alias("content_quality"), F.round(B.title_quality(F.col("title")), 6).alias("title_quality"))


@query(f"WITH {PARTS} SELECT id, round(engagement_potential, 6) AS engagement_potential FROM whole")
def c10_engagement_potential(spark, d):
    return scored(spark, d).select("id", F.round(parts()["engagement_potential"], 6).alias("engagement_potential"))


def _list(*cases: str) -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} END' for c in cases)}], lambda x: x IS NOT NULL), '|')"


STRONG = _list(*[f"round({k}, 9) >= 0.8 THEN '{v}'" for k, v in B.STRENGTHS.items()])
WEAK = _list(*[f"round({k}, 9) < 0.4 THEN '{v}'" for k, v in B.WEAK.items()])
DATED = """CASE WHEN age IS NULL THEN 'Fecha de publicación desconocida (-)' WHEN floor(age / 24) = 0 THEN 'Publicado hoy (+)'
  ELSE 'Publicado hace ' || CAST(CAST(floor(age / 24) AS BIGINT) AS VARCHAR) || ' días' || CASE WHEN floor(age / 24) <= 3 THEN ' (+)' WHEN floor(age / 24) <= 7 THEN '' ELSE ' (-)' END END"""


@query(f"""WITH {PARTS} SELECT id, CASE WHEN round(final, 9) >= 0.8 THEN 'excelente' WHEN round(final, 9) >= 0.6 THEN 'muy bueno' WHEN round(final, 9) >= 0.4 THEN 'bueno' WHEN round(final, 9) >= 0.2 THEN 'regular' ELSE 'bajo' END AS assessment,
  {STRONG} AS strengths, {WEAK} AS weak, round(content_quality * 0.4::DOUBLE, 6) AS content_part, CASE WHEN round(final, 9) >= 0.3 THEN 'include' ELSE 'exclude' END AS recommendation, {DATED} AS dated,
  array_to_string(list_filter([CASE WHEN reviewed THEN 'Artículo peer-reviewed (+)' WHEN preprint THEN 'Preprint sin peer review (-)' END, CASE WHEN doi <> '' THEN 'Tiene DOI (+)' END,
    CASE WHEN journal IS NOT NULL THEN 'Publicado en ' || journal END], lambda x: x IS NOT NULL), '|') AS sourced FROM whole""")
def c11_explanation(spark, d):
    p = {k: F.round(v, 9) for k, v in parts().items()}
    c = F.col
    lines = B.factors(c("title"), c("content"), c("reviewed"), c("preprint"), c("doi"), c("journal"), c("age"))
    rows = scored(spark, d).select("id", B.explanation(F.round(B.basic_score(parts()), 9), p, lines).alias("e"))
    part = F.col("e.component_breakdown")
    return rows.select(
        "id", F.col("e.overall_assessment").alias("assessment"), F.array_join("e.key_strengths", "|").alias("strengths"), F.array_join("e.improvement_areas", "|").alias("weak"),
        F.round(part["content_quality"]["contribution"], 6).alias("content_part"), F.col("e.recommendation").alias("recommendation"),
        F.array_join(part["recency"]["factors"], "|").alias("dated"), F.array_join(part["source_credibility"]["factors"], "|").alias("sourced"),
    )


DIMENSIONS = ("substance", "narrative", "relevance", "credibility")


@query(f"""WITH {PARTS}, rated AS (
  SELECT *, {", ".join(f"CASE WHEN id % 4 = 0 THEN score ELSE least(1.0::DOUBLE, ((id + {i}) % 6) / 5.0::DOUBLE) END AS own_{k}" for i, k in enumerate(DIMENSIONS))},
         {any_sql("t", L.LATAM)} AS latam, {any_sql("t", L.LOW_VALUE)} AS low FROM whole WHERE score IS NOT NULL),
  fitted AS (SELECT *, CASE WHEN low AND NOT latam THEN 0.0::DOUBLE WHEN latam THEN least(1.0::DOUBLE, own_relevance + 0.2::DOUBLE) ELSE own_relevance END AS relevance FROM rated),
  blended AS (SELECT *, greatest(0, least(1, own_substance * 0.4::DOUBLE + own_narrative * 0.4::DOUBLE + (recency * 0.5::DOUBLE + relevance * 0.5::DOUBLE) * 0.1::DOUBLE
    + (source_credibility * 0.5::DOUBLE + own_credibility * 0.5::DOUBLE) * 0.1::DOUBLE)) AS total FROM fitted),
  gated AS (SELECT *, round(CASE WHEN relevance < 0.4 THEN least(total, 0.55::DOUBLE) ELSE total END, 4) AS final_score FROM blended)
  SELECT id, final_score, CASE WHEN final_score >= 0.75 THEN 'priority' WHEN final_score >= 0.60 THEN 'publishable' ELSE 'discard' END AS decision_label, round(relevance, 4) AS nqi_relevance FROM gated""")
def c13_cognitive_blend(spark, d):
    rows = scored(spark, d).where("score IS NOT NULL")
    dims = {k: F.when(F.col("id") % 4 != 0, ((F.col("id") + i) % 6).cast("double")) for i, k in enumerate(DIMENSIONS)}
    p = parts()
    out = scoring.cognitive_blend(B.both(F.col("title"), F.col("content")), p["source_credibility"], p["recency"], dims, F.col("score"), B.WEIGHTS)
    made = rows.select("id", out["final_score"].alias("final_score"), out["nqi_relevance"].alias("nqi_relevance"))
    label = F.when(F.col("final_score") >= 0.75, "priority").when(F.col("final_score") >= 0.60, "publishable").otherwise("discard")
    return made.select("id", "final_score", label.alias("decision_label"), "nqi_relevance")


@query(f"""WITH {PARTS}, fresh AS (SELECT id, final AS basic FROM whole WHERE id % 3 = 0), log AS (SELECT id AS article_id, round(basic, 6) AS score, 2 AS version FROM fresh UNION ALL SELECT id, round(score, 6), 1 FROM articles WHERE score IS NOT NULL)
  SELECT article_id, count(*) AS n, max(version) AS version, arg_max(score, version) AS score FROM log GROUP BY 1""")
def c16_score_log(spark, d):
    rows = scored(spark, d)
    old = rows.where("score IS NOT NULL").select(F.col("id").alias("article_id"), F.round("score", 6).alias("score"), F.lit(1).alias("version"))
    fresh = rows.where("id % 3 = 0").select(F.col("id").alias("article_id"), F.round(B.basic_score(parts()), 6).alias("score"), F.lit(2).alias("version"))
    updated, log = scoring.persist_scores(rows.select(F.col("id").alias("article_id"), "score"), old, fresh, "article_id", ["score"])
    newest = log.groupBy("article_id").agg(F.count("*").alias("n"), F.max("version").alias("version"))
    return newest.join(updated, "article_id").select("article_id", "n", "version", F.round("score", 6).alias("score"))


@query(f"WITH {ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(score, 0.0) DESC, id) AS i, count(*) OVER (PARTITION BY source) AS n FROM articles) SELECT source, count(*) FILTER (relevance > 1) / least(10, max(n))::DOUBLE AS precision FROM r WHERE i <= 10 GROUP BY source")
def c18_precision_at(spark, d):
    rows = articles(spark, d).select("source", "id", (F.col("relevance") > 1).alias("positive"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return ranking.precision_at(rows, "source", "score", "positive", "id", 10)


@query(f"WITH {PARTS}, r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'basic' WHEN id % 3 = 1 THEN 'feature' ELSE 'cognitive' END AS mode FROM whole) SELECT mode, count(*) AS n, round(avg(CASE mode WHEN 'basic' THEN final WHEN 'feature' THEN recency ELSE content_quality END), 6) AS mean FROM r GROUP BY mode")
def c15_scorer_choice(spark, d):
    i, p = F.col("id"), parts()
    mode = F.when(i % 3 == 0, scoring.scorer_of("basic")).when(i % 3 == 1, scoring.scorer_of("unheard of")).otherwise(scoring.scorer_of("cognitive"))
    rows = scored(spark, d).select(mode.alias("mode"), B.basic_score(p).alias("basic"), p["recency"].alias("feature"), p["content_quality"].alias("cognitive"))
    chosen = F.element_at(F.create_map(*[x for k in scoring.SCORERS for x in (F.lit(k), F.col(k))]), F.col("mode"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg(chosen), 6).alias("mean"))


# ---- selections: preselection, chunks, sets of pages


AUDIENCE = f"""aud AS (SELECT id, title, content, source, lower(concat_ws(' ', title, content, source)) AS t FROM articles),
ranked AS (SELECT id, round(4.0::DOUBLE * ({count_sql("t", L.LATAM)}) + 2.5::DOUBLE * ({count_sql("t", L.SCIENCE)}) - 3.5::DOUBLE * ({count_sql("t", L.LOW_VALUE)}) + least(length(content) / 140.0::DOUBLE, 1.5) + least(length(title) / 80.0::DOUBLE, 0.5)
    + CASE WHEN {any_sql("t", ("study", "research", "scientists", "data"))} THEN 1 ELSE 0 END + CASE WHEN {any_sql("t", L.TECH)} THEN 1.5 ELSE 0 END - CASE WHEN {any_sql("t", ("partnership", "portal"))} THEN 1 ELSE 0 END, 9) AS score FROM aud)"""


def _audience(spark, d) -> DataFrame:
    return articles(spark, d).select("id", F.round(scoring.audience_score(F.col("title"), F.col("content"), F.col("source")), 9).alias("score"))


@query(f"WITH {ARTICLES}, {AUDIENCE} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM ranked QUALIFY place <= 100")
def w6_candidate_ranking(spark, d):
    return selection.ranked_candidates(_audience(spark, d), "score", "id", 100)


@query(f"""WITH {ARTICLES}, {AUDIENCE}, picked AS (SELECT id, (id * 37) % 101 AS pos FROM articles WHERE id % 50 = 7), chosen AS (
    SELECT id, 0 AS turn, pos AS a, 0.0::DOUBLE AS s FROM picked UNION ALL SELECT id, 1, 0, score FROM ranked WHERE id NOT IN (SELECT id FROM picked))
  SELECT id, row_number() OVER (ORDER BY turn, a, s DESC, id) AS place, turn = 0 AS picked FROM chosen QUALIFY place <= 60""")
def k7_preselection(spark, d):
    picked = articles(spark, d).where("id % 50 = 7").select("id", (F.col("id") * 37 % 101).alias("at"))
    twice = picked.union(picked.withColumn("at", F.col("at") + 1000)).union(picked.limit(1).select(F.lit(-5).cast("long"), F.lit(0).cast("long")))  # repeats and unknown ids
    return selection.preselect(_audience(spark, d), twice, "score", "id", "at", 60)


@query(f"""WITH {ARTICLES}, a AS (SELECT source, id, length('Title: ' || coalesce(title, '') || chr(10) || 'Summary: ' || chr(10) || 'Content: ' || substr(coalesce(content, ''), 1, 800)) AS size FROM articles),
  e AS (SELECT source, list({{'i': id, 's': size, 'c': 0::BIGINT, 'n': 0::BIGINT, 't': 0::BIGINT, 'done': CAST([] AS STRUCT(i BIGINT, c BIGINT)[])}} ORDER BY id) AS l FROM a GROUP BY 1),
  r AS (SELECT source, list_reduce(list_prepend({{'i': -1::BIGINT, 's': 0::BIGINT, 'c': 0::BIGINT, 'n': 0::BIGINT, 't': 0::BIGINT, 'done': CAST([] AS STRUCT(i BIGINT, c BIGINT)[])}}, l), lambda b, x: {{'i': x.i, 's': x.s,
    'c': b.c + CASE WHEN b.n > 0 AND (b.n >= 8 OR b.t + x.s > 4000) THEN 1 ELSE 0 END, 'n': CASE WHEN b.n > 0 AND (b.n >= 8 OR b.t + x.s > 4000) THEN 1 ELSE b.n + 1 END, 't': CASE WHEN b.n > 0 AND (b.n >= 8 OR b.t + x.s > 4000) THEN x.s ELSE b.t + x.s END,
    'done': list_append(b.done, {{'i': x.i, 'c': b.c + CASE WHEN b.n > 0 AND (b.n >= 8 OR b.t + x.s > 4000) THEN 1 ELSE 0 END}})}}).done AS done FROM e), u AS (SELECT source, unnest(done) AS d FROM r)
  SELECT source, d.i AS id, d.c AS chunk FROM u""")
def w4_prompt_chunks(spark, d):
    rows = articles(spark, d).select("source", "id", selection.prompt_size(F.col("title"), F.lit(""), F.col("content")).alias("size"))
    return selection.chunks(rows, "source", "id", "size", 8, 4000)


@query(f"WITH {ARTICLES}, a AS (SELECT id, score FROM articles WHERE score >= 0.9), b AS (SELECT id, score FROM articles WHERE language = 'en' AND score >= 0.85) SELECT id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def u6_union_pages(spark, d):
    rows = articles(spark, d).select("id", "score", "language")
    pages = [rows.where("score >= 0.9"), rows.where("language = 'en' AND score >= 0.85").drop("language")]
    return selection.append_pages(pages).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {ARTICLES} SELECT id, source, language, title, score, length(content) AS n_chars FROM articles")
def p10_published_projection(spark, d):
    rows = articles(spark, d).withColumn("article_metadata", F.lit("{}")).withColumn("n_chars", F.length("content"))
    return selection.published_view(rows.drop("content", "relevance"))


@query(f"""WITH {ARTICLES}, top AS (SELECT * FROM articles WHERE score >= 0.3 ORDER BY score DESC, id DESC LIMIT 200), {capped_sql("SELECT id, score, coalesce(source, 'unknown') AS source, [language] AS topics FROM top", 20, 5, 12)}
  SELECT CAST(place AS INTEGER) AS place, t.score AS score, t.id AS id, t.source AS source FROM chosen""")
def k6_top_articles(spark, d):
    rows = articles(spark, d).where("score IS NOT NULL").withColumn("topics", F.array("language"))
    top = ranking.top_k(rows.withColumn("published", F.lpad(F.col("id").cast("string"), 20, "0")), 0.3, 200)
    return ranking.capped(top, 20, 0.25, 0.6).drop("topics")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, row_number() OVER (ORDER BY count(*) FILTER (event_type = 'error') DESC, user_id) AS place FROM events GROUP BY user_id QUALIFY place <= 50")
def k8_failing_listing(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return selection.ranked_candidates(per, "failures", "user_id", 50)


@query("WITH cache AS (SELECT doc_id, quality * 0.5::DOUBLE AS score FROM labels) SELECT d.doc_id, coalesce(c.score, d.n_chars % 10 / 10.0::DOUBLE) AS score, c.score IS NOT NULL AS cached FROM documents d LEFT JOIN cache c USING (doc_id)")
def j13_cached_scores(spark, d):
    cache = table(spark, d, "labels").select("doc_id", (F.col("quality") * 0.5).alias("score"))
    return selection.with_cache(table(spark, d, "documents"), cache, "doc_id", "score", (F.col("n_chars") % 10) / 10.0).select("doc_id", "score", "cached")
