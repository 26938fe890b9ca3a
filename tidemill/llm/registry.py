"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import centroids, chat, divergence, fingerprints, jaccard, line_dedup, media, mixing, packing, quality, secrets, suffixes, token_files
from tidemill.llm.common import documents, labels
from tidemill.llm.tokens import BYTE_BPE

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_documents(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeated_bytes(documents(spark, sf_dir)).drop("text")


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(documents(spark, sf_dir))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(documents(spark, sf_dir))
    return mixed.withColumn("first_position", F.round("first_position", 6))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_documents(chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = [op1_token_files, op2_line_dedup, op3_secret_scan, op4_quality_rules, op5_best_fit_packing, op6_suffix_dedup, op7_media_chunks, op8_order_minhash, op9_jaccard_join, op10_source_mixing]
    found += [op11_centroid_clusters, op12_chat_examples, op13_source_divergence]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES_SQL, "op10_source_mixing": MIXING_SQL,
        "op11_centroid_clusters": clusters_sql(), "op12_chat_examples": CHAT_SQL, "op13_source_divergence": DIVERGENCE_SQL,
    }


LINES_SQL = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM texts),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
rolled AS (SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31) % 1000003 AS r FROM hashed),
marked AS (
  SELECT *, i > 0 AND i < n - 2 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM rolled),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM marked),
chunks AS (
  SELECT doc_id, c, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY i) AS chunk, list(line ORDER BY i) AS own FROM numbered GROUP BY doc_id, c),
beside AS (
  SELECT *, list_reverse(list_concat(lag(own, 2) OVER w, lag(own) OVER w)) AS before, list_concat(lead(own) OVER w, lead(own, 2) OVER w) AS after
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
multi AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS k FROM beside WHERE last > first AND regexp_matches(chunk, '\S')),
pairs AS (
  SELECT m.doc_id, m.first, m.last, m.before, m.after, f.before AS first_before, f.after AS first_after
  FROM multi m JOIN multi f ON m.chunk = f.chunk AND f.k = 1 WHERE m.k > 1),
spans AS (
  SELECT doc_id, first AS chunk,
         first - coalesce(list_position(list_transform(range(1, least(len(before), len(first_before)) + 1), lambda x: before[x] = first_before[x]), false) - 1,
                          least(len(before), len(first_before))) AS first,
         last + coalesce(list_position(list_transform(range(1, least(len(after), len(first_after)) + 1), lambda x: after[x] = first_after[x]), false) - 1,
                         least(len(after), len(first_after))) AS last
  FROM pairs),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM spans),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
         coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id),
counted AS (SELECT doc_id, count(DISTINCT chunk) AS n_chunks FROM spans GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, coalesce(c.n_chunks, 0) AS n_chunks
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""


MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS rank
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
named AS (
  SELECT *, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM per)),
stops AS (SELECT *, 2 * source_size / weight AS stop FROM named),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
     - coalesce(sum(2 * source_size) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM stops),
fixed AS (SELECT arg_min(level, stop) AS level FROM levels WHERE level <= stop),
targets AS (
  SELECT n.source, n.source_size, n.place, least(CAST(2 * n.source_size AS DOUBLE), f.level * n.weight) AS target
  FROM named n, fixed f),
placed AS (
  SELECT r.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
         CASE t.place WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE t.place WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS bend,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source
           ORDER BY CAST(('0x' || substr(r.rank, 1, 6)) AS BIGINT) % 4096, r.rank, r.doc_id, r.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, words - before)) + greatest(0, least(size, words - source_size - before)) AS BIGINT) AS taken,
       CASE WHEN least(size, words - before) <= 0 THEN NULL
            WHEN bend = 0 THEN round((before + least(size, words - before) / 2.0::DOUBLE) / greatest(target, 1.0::DOUBLE) / w0, 6)
            ELSE round((sqrt(w0 * w0 + 2 * bend * ((before + least(size, words - before) / 2.0::DOUBLE) / greatest(target, 1.0::DOUBLE))) - w0) / bend, 6)
       END AS first_position
FROM placed
"""


def clusters_sql(rounds: int = 3) -> str:
    """The assignments and means of each round written out, over components one by one."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
far{n} AS (SELECT p.r, c.c, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM points p JOIN centers{n} c ON p.i = c.i GROUP BY p.r, c.c),
near{n} AS (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS k FROM far{n}) WHERE k = 1)""")
        if n < rounds:
            steps.append(f"""
means{n} AS (SELECT n.c, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS m FROM near{n} n JOIN points p ON p.r = n.r GROUP BY n.c, p.i),
centers{n + 1} AS (
  SELECT c.c, c.i, coalesce((m.s - ((m.s % m.m) + m.m) % m.m) // m.m, c.x) AS x FROM centers{n} c LEFT JOIN means{n} m ON m.c = c.c AND m.i = c.i)""")
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS r FROM whole),
points AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ranked),
centers0 AS (SELECT r - 1 AS c, i, x FROM points WHERE r <= 16),{",".join(steps)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centers{rounds} GROUP BY c)
SELECT w.vec_id, CAST(n.c AS INTEGER) AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} n JOIN ranked w ON w.r = n.r JOIN digests g ON g.c = n.c
"""


CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\t') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\t'), ': ', '\c') AS speaker
  FROM said),
placed AS (SELECT *, sum(length('### ' || speaker || ': ' || body || '</turn>' || chr(10))) OVER (PARTITION BY conv_id ORDER BY i) AS until FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(until) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.c, 0) AS HUGEINT) AS c
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (
  SELECT d.*, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY d.lang, d.source) + s.v) AS p FROM dense d JOIN sizes s ON s.lang = d.lang),
alls AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term),
whole AS (SELECT a.lang, a.term, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY a.lang) + s.v) AS q FROM alls a JOIN sizes s ON s.lang = a.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT o.lang, o.source, 'term' AS part, o.term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM own o JOIN whole w ON w.lang = o.lang AND w.term = o.term WHERE o.c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
