"""Queries of the training-data operators, over whole tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, decontamination, html_text, jaccard_join, language, mixing, quality_rules, resampling, secrets, token_counts, toxicity, training_order
from .common import documents, held_out


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_counts(documents(spark, sf_dir), ["doc_id"], changes=False)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.digests(secrets.findings(docs, secrets.update(docs, None), ["doc_id"]), ["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), ["doc_id"], ids=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = language.language(documents(spark, sf_dir), ["doc_id"])
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_training_order, op2_token_counts, op3_jaccard_join, op4_secret_scan, op5_toxicity, op6_html_text, op7_quality_rules, op8_decontamination, op9_bpe, op10_language, op11_importance_resampling, op12_source_mixing, op13_token_alignment)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.r = ways.x
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KINDS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, {_quoted(p)}) AS hit, "
    f"regexp_extract_all(text, {_quoted(p)}, {int(kind == 'assign')}) AS val, regexp_split_to_array(text, {_quoted(p)}) AS gap FROM t"
    for k, (kind, p) in enumerate(secrets.PATTERNS.items())
)

SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_KINDS}),
e AS (SELECT doc_id, kind, k, gap, hit, val, unnest(range(1, len(hit) + 1)) AS i FROM m WHERE len(hit) > 0),
p AS (
  SELECT doc_id, kind, k, length(hit[i]) AS n,
    (list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda g: length(g))), 0))::BIGINT AS s
  FROM e WHERE kind <> 'assign' OR length(val[i]) >= 8
),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
  FROM p GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""

#: The draw. A CRC follows from a table of 256 numbers, itself eight shifts of each; strings are taken apart by their hexadecimal bytes.
RESAMPLING_SQL = rf"""
WITH steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {resampling.POLYNOMIAL}) ELSE c >> 1 END, v) ORDER BY v) AS step FROM range(256) t(v)
), words AS (
  SELECT TRUE AS own, rowid AS r, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
  UNION ALL SELECT FALSE, 0, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), grams AS (
  SELECT own, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words
), hexed AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)
), bytes AS (
  SELECT g, list_transform(range(0, length(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT) AS b FROM hexed
), buckets AS (
  SELECT g, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {resampling.BUCKETS} AS bucket FROM bytes, steps
), sums AS (
  SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM grams JOIN buckets USING (g) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {resampling.BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS total FROM grams JOIN buckets USING (g) JOIN gains USING (bucket) WHERE own GROUP BY r
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, coalesce(len(w), 0) >= {resampling.LEAST} AS eligible,
    list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', sha256('{resampling.KEY}:' || coalesce(d.doc_id::VARCHAR, ''))[i]) - 1)::BIGINT), lambda a, x: 16 * a + x) AS h
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN weights USING (r) LEFT JOIN (SELECT r, w FROM words WHERE own) USING (r)
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS k, count(*) FILTER (eligible) OVER () AS n FROM noisy
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN eligible AND k <= {resampling.PERCENT} * n // 100 THEN k END AS rank FROM ranked
"""

SQL = {"op3_jaccard_join": JACCARD_SQL, "op4_secret_scan": SECRETS_SQL, "op11_importance_resampling": RESAMPLING_SQL}
