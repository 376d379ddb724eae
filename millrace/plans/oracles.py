"""SQL for the catalogue's queries, over the same tables."""

from __future__ import annotations

import random

from millrace.operators.matching import RULES
from millrace.plans.settings import BENCHMARK, CHUNK, CHUNKS, COVERAGE_STEPS, LENGTH, MTP_WEIGHTS, RECENT, SEED, STEP, VALID

SQL: dict[str, str] = {}

CHARS = r"regexp_replace(lower(text), '\s+', '', 'g')"
WORDS = "regexp_extract_all(lower(text), '[0-9a-z]+')"
CJK = "coalesce(length(regexp_replace(text, '[^぀-ヿ一-鿿]', '', 'g')) / nullif(length(text), 0) >= 0.15, false)"

SQL["norm_chars"] = f"SELECT doc_id, {CHARS} AS chars FROM documents"
SQL["norm_words"] = f"SELECT doc_id, array_to_string({WORDS}, ' ') AS words FROM documents"
SQL["is_cjk"] = f"SELECT doc_id, {CJK} AS is_cjk FROM documents"
SQL["line_documents"] = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(t))) AS line, unnest(t) AS text FROM l)
SELECT doc_id, line::BIGINT AS line, text FROM e WHERE regexp_replace(text, '\s+', '', 'g') <> ''
"""
SQL["text_digest"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"

RECORDS = f"""rec AS (
  SELECT item_id AS record_id, text, {CHARS} AS c, {WORDS} AS w, {CJK} AS cjk,
    CASE WHEN {CJK} THEN {CHARS} ELSE array_to_string({WORDS}, ' ') END AS key FROM benchmark
), cg AS (
  SELECT record_id, unnest(range(0, length(c) - 19))::BIGINT AS pos, c FROM rec WHERE length(c) >= 20
), wg AS (
  SELECT record_id, unnest(range(0, len(w) - 12))::BIGINT AS pos, w FROM rec WHERE len(w) >= 13
), rc AS (SELECT record_id, pos, substr(c, pos + 1, 20) AS gram FROM cg
), rw AS (SELECT record_id, pos, array_to_string(w[pos + 1:pos + 13], ' ') AS gram FROM wg)"""

SQL["file_lines"] = """
WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS text FROM l
"""
SQL["record_keys"] = f"WITH {RECORDS} SELECT record_id, key, length(key) AS key_chars FROM rec"
SQL["char_ngrams"] = f"WITH {RECORDS} SELECT record_id, pos, gram FROM rc"
SQL["word_ngrams"] = f"WITH {RECORDS} SELECT record_id, pos, gram FROM rw"
SQL["index_stats"] = f"""
WITH {RECORDS}, n AS (SELECT key, cjk, greatest(length(c) - 19, 0) + greatest(len(w) - 12, 0) AS n FROM rec)
SELECT '{BENCHMARK}' AS benchmark, count(*) AS examples, count(*) FILTER (n > 0) AS with_ngrams, count(*) FILTER (n = 0 AND length(key) >= 8) AS short_exact_match,
  count(*) FILTER (n = 0 AND length(key) < 8) AS unmatchable, round(count(*) FILTER (n > 0 OR length(key) >= 8) / count(*), 6) AS coverage,
  sum(n)::BIGINT AS ngrams, bool_or(cjk) AS has_cjk FROM n
"""

DOC_WORDS = f"""dw AS (SELECT doc_id, {WORDS} AS l FROM documents),
dwp AS (SELECT doc_id, len(l) - 12 AS n, unnest(range(0, len(l))) AS pos, unnest(l) AS w FROM dw WHERE len(l) >= 13),
dws AS (SELECT doc_id, n, pos, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram FROM dwp),
wh AS (SELECT 'latin' AS script, doc_id, pos, n, gram FROM dws WHERE pos < n)"""
SPANS = """isl AS (SELECT script, doc_id, pos - row_number() OVER (PARTITION BY script, doc_id ORDER BY pos) AS g FROM hits),
runs AS (SELECT script, doc_id, max(run) AS run FROM (SELECT script, doc_id, g, count(*) AS run FROM isl GROUP BY ALL) GROUP BY ALL),
dist AS (SELECT script, doc_id, count(DISTINCT gram) AS d FROM hits GROUP BY ALL),
per AS (SELECT script, doc_id, d, run + CASE WHEN script = 'cjk' THEN 19 ELSE 12 END AS span FROM runs JOIN dist USING (script, doc_id)),
ok AS (SELECT * FROM per WHERE d >= 2 AND span >= CASE WHEN script = 'cjk' THEN 30 ELSE 20 END),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span DESC, script) AS k,
  max(span) FILTER (script = 'cjk') OVER (PARTITION BY doc_id) AS span_cjk, max(span) FILTER (script = 'latin') OVER (PARTITION BY doc_id) AS span_latin FROM ok)"""
# contamination_span and contamination_screen look at every 20 characters, which takes SQL minutes: tests hold them against brute force.
SQL["contamination_word_span"] = f"WITH {RECORDS}, {DOC_WORDS}, hits AS (SELECT * FROM wh WHERE gram IN (SELECT gram FROM rw)), {SPANS} SELECT doc_id, d AS distinct, span FROM best WHERE k = 1"
SQL["exact_record"] = f"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark),
keys AS (SELECT DISTINCT array_to_string({WORDS}, ' ') AS key FROM lines),
parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents UNION ALL SELECT doc_id, text FROM documents)
SELECT DISTINCT doc_id FROM parts JOIN keys ON key = array_to_string({WORDS}, ' ') WHERE length(key) >= 8
"""

_rule = RULES[BENCHMARK]
#: No record is CJK text here, so all are matched by words; grams of characters hold no space and can't be among them.
FINDINGS = f"""{RECORDS}, {DOC_WORDS}, rg AS (
  SELECT r.record_id, pos, gram FROM rec r JOIN rc USING (record_id) WHERE cjk UNION ALL SELECT r.record_id, pos, gram FROM rec r JOIN rw USING (record_id) WHERE NOT cjk
), total AS (SELECT record_id, count(*) AS n FROM rg GROUP BY ALL
), have AS (
  SELECT DISTINCT doc_id, gram FROM wh WHERE gram IN (SELECT gram FROM rg)
), m AS (SELECT doc_id, record_id, pos FROM have JOIN rg USING (gram)
), isl AS (SELECT doc_id, record_id, pos, pos - row_number() OVER (PARTITION BY doc_id, record_id ORDER BY pos) AS g FROM m
), runs AS (SELECT doc_id, record_id, count(*) AS run, min(pos) AS start FROM isl GROUP BY doc_id, record_id, g
), top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, record_id ORDER BY run DESC, start) AS k, sum(run) OVER (PARTITION BY doc_id, record_id) AS matched FROM runs
), f AS (
  SELECT t.doc_id, t.record_id, total.n AS record_ngrams, matched::BIGINT AS matched, matched / total.n AS coverage, run AS contiguous_ngrams,
    run + CASE WHEN cjk THEN 19 ELSE 12 END AS contiguous_units, run / total.n AS contiguous_fraction, length(key) AS record_chars,
    left(CASE WHEN cjk THEN substr(c, start + 1, run + 19) ELSE array_to_string(w[start + 1:start + run + 12], ' ') END, 300) AS matched_text,
    length(key) >= 12 AND (contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), key) OR contains(array_to_string(regexp_extract_all(lower(d.text), '[0-9a-z]+'), ' '), key)) AS substring
  FROM top t JOIN total USING (record_id) JOIN rec USING (record_id) JOIN documents d ON d.doc_id = t.doc_id WHERE k = 1
), decided AS (SELECT *, substring OR (coverage >= {_rule[0]} AND contiguous_fraction >= {_rule[1]}) AS contaminated FROM f)"""
SQL["record_coverage"] = f"WITH {FINDINGS} SELECT doc_id, record_id, record_ngrams, matched, round(coverage, 6) AS coverage, contaminated FROM decided"
SQL["record_longest_run"] = f"WITH {FINDINGS} SELECT doc_id, record_id, contiguous_ngrams, contiguous_units, round(contiguous_fraction, 6) AS contiguous_fraction, matched_text FROM decided"
SQL["record_substring"] = f"WITH {FINDINGS} SELECT doc_id, record_id, record_chars FROM decided WHERE substring"
SQL["best_finding"] = f"""
WITH {FINDINGS} SELECT doc_id, record_id, '{BENCHMARK}' AS benchmark, round(coverage, 6) AS coverage, contiguous_units FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(coverage, 4) DESC, contiguous_units DESC, record_id) AS b FROM decided WHERE contaminated) WHERE b = 1
"""
SQL["short_record_substring"] = f"""
WITH words AS (SELECT item_id, {WORDS} AS w FROM benchmark
), parts AS (SELECT item_id * 10000 + i AS record_id, array_to_string(w[4 * i + 1:4 * i + 4], ' ') AS key FROM words, range(0, 100000) r(i) WHERE i <= len(w) // 4
), docs AS (SELECT doc_id, {CHARS} AS c, array_to_string({WORDS}, ' ') AS w, len({WORDS}) AS n FROM documents)
SELECT doc_id, record_id, length(key) AS record_chars FROM parts, docs WHERE length(key) >= 12 AND (length(c) >= 20 OR n >= 13) AND (contains(c, key) OR contains(w, key))
"""
SQL["part_selection"] = """
WITH n AS (SELECT ['gsm8k', 'humaneval', 'mbpp', 'jnli'][item_id % 4 + 1] AS benchmark, text, string_split(text, '.')[1] AS first, string_split(text, '.')[-1] AS second FROM benchmark),
p AS (
  SELECT benchmark, text FROM n WHERE benchmark = 'jnli'
  UNION ALL SELECT CASE benchmark WHEN 'gsm8k' THEN 'gsm8k_question' WHEN 'humaneval' THEN 'humaneval_prompt' ELSE 'mbpp_prompt' END, first FROM n WHERE benchmark <> 'jnli'
  UNION ALL SELECT CASE benchmark WHEN 'gsm8k' THEN 'gsm8k_answer' WHEN 'humaneval' THEN 'humaneval_solution' ELSE 'mbpp_solution' END, second FROM n WHERE benchmark <> 'jnli'
)
SELECT benchmark, count(*) AS records, sum(length(text))::BIGINT AS chars FROM p GROUP BY ALL
"""

TOKENS = r"""tok AS (
  SELECT source AS source_id, doc_id AS doc_seq, list_append(list_transform(regexp_extract_all(text, '[^ \n\t\r]+'), lambda w: (('0x' || substr(md5(w), 1, 7))::BIGINT % 49147 + 5)::INT), 4::INT) AS tokens FROM documents WHERE text <> ''
)"""
LENGTHS = r"len AS (SELECT source AS source_id, doc_id AS doc_seq, (len(regexp_extract_all(text, '[^ \n\t\r]+')) + 1)::BIGINT AS n_tokens FROM documents WHERE text <> '')"
SHARDS = f"""{LENGTHS}, sh AS (
  SELECT CASE WHEN doc_seq % 10 = 0 THEN 'validation' ELSE 'train' END AS split, source_id, sum(n_tokens)::BIGINT AS tokens, count(*) AS documents FROM len GROUP BY ALL
), shards AS (SELECT *, source_id || '-' || split || '-00000.bin' AS path FROM sh)"""
SQL["pack_tokens"] = f"WITH {TOKENS} SELECT source_id, doc_seq, array_to_string(tokens, ' ') AS tokens FROM tok"
OFFSETS = f"{LENGTHS}, off AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source_id ORDER BY doc_seq))::BIGINT AS e FROM len)"
SQL["pack_offsets"] = f'WITH {OFFSETS} SELECT source_id, doc_seq, n_tokens, e AS "end", e - n_tokens AS start FROM off'
SQL["shard_totals"] = f"WITH {SHARDS} SELECT split, source_id, tokens, documents, path FROM shards"
SQL["split_totals"] = f"WITH {SHARDS} SELECT split, sum(tokens)::BIGINT AS tokens, sum(documents)::BIGINT AS documents, count(*) AS shards FROM shards GROUP BY ALL"
SQL["source_weights"] = f"""
WITH {SHARDS}, p AS (SELECT source_id, sum(tokens)::BIGINT AS tokens FROM shards WHERE split = 'train' GROUP BY ALL)
SELECT source_id, tokens, round(tokens / (SELECT sum(tokens) FROM p), 9) AS weight, tokens / (SELECT sum(tokens) FROM p) >= 0.01 AS major FROM p
"""
SQL["source_upsert"] = f"WITH {SHARDS} SELECT split, source_id, tokens + CASE WHEN split = 'train' AND documents % 2 = 0 THEN 1 ELSE 0 END AS tokens, documents, path FROM shards"
WEIGHTS = f"""{SHARDS}, pw AS (SELECT source_id, sum(tokens)::BIGINT AS tokens FROM shards GROUP BY ALL),
weights AS (SELECT source_id, tokens, tokens / (SELECT sum(tokens) FROM pw) AS share FROM pw)"""
SQL["manifest_violations"] = f"""
WITH {WEIGHTS} SELECT source_id, 'weight isn''t finite and positive' AS violation FROM weights WHERE tokens % 3 = 0
UNION ALL SELECT source_id, 'major isn''t given' FROM weights WHERE tokens % 5 = 0
"""
SQL["manifest_legacy"] = f"""
WITH {SHARDS}, t AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM shards WHERE split = 'train')
SELECT source_id, round(share, 9) AS weight, share >= 0.01 AS major, path, replace(path, '.bin', '.idx') AS index, tokens, documents, 'datamix_v2_filename_prefix_v1' AS adapter FROM t
"""
SQL["manifest_canonical"] = f"""
WITH {WEIGHTS} SELECT source_id, round(share, 9) AS weight, share >= 0.01 AS major, path, replace(path, '.bin', '.idx') AS index, s.tokens, documents, 'canonical_interleave_v1' AS adapter FROM shards s JOIN weights USING (source_id)
"""
SQL["manifest_validation"] = f"WITH {SHARDS} SELECT source_id AS source, path, CASE WHEN documents % 2 = 0 THEN documents ELSE 1 END::DOUBLE AS weight FROM shards WHERE split = 'validation'"
SQL["legacy_source"] = f"WITH {SHARDS} SELECT path, CASE WHEN path LIKE '%-train-00000.bin' THEN source_id ELSE string_split(path, '-')[1] END AS source_id FROM shards"

def _turned(x: str, y: str, m: str) -> str:
    """A word of the generator's next state from three of this one's."""
    z = f"(({x} & 2147483648) | ({y} & 2147483647))"
    return f"xor(xor({m}, {z} >> 1), ({z} & 1) * 2567483615)"


#: The selection's numbers: the state turns over every 312 draws, often enough for every source to have given all its tokens.
DRAWS = f"""mt(i, k) AS (
  SELECT 0, {[*random.Random(SEED).getstate()[1][:-1]]}::BIGINT[]
  UNION ALL SELECT i + 1, a || b || c || [{_turned('k[624]', 'a[1]', 'b[170]')}] FROM (
    SELECT *, list_transform(range(1, 170), lambda j: {_turned('k[454 + j]', 'k[455 + j]', 'b[j]')}) AS c FROM (
      SELECT *, list_transform(range(1, 228), lambda j: {_turned('k[227 + j]', 'k[228 + j]', 'a[j]')}) AS b FROM (
        SELECT *, list_transform(range(1, 228), lambda j: {_turned('k[j]', 'k[j + 1]', 'k[397 + j]')}) AS a FROM mt
        WHERE i * 312 < greatest({CHUNKS}, (SELECT 1.3 * max(ceil(tokens / {CHUNK}) / share) + 700 FROM weights)))))
), bits1 AS (SELECT i, list_transform(k, lambda y: xor(y, y >> 11)) AS k FROM mt WHERE i > 0
), bits2 AS (SELECT i, list_transform(k, lambda y: xor(y, (y << 7) & 2636928640)) AS k FROM bits1
), bits3 AS (SELECT i, list_transform(k, lambda y: xor(y, (y << 15) & 4022730752)) AS k FROM bits2
), bits4 AS (SELECT i, list_transform(k, lambda y: xor(y, y >> 18)) AS k FROM bits3
), u AS (
  SELECT (i - 1) * 312 + j AS chunk_id, ((k[2 * j + 1] >> 5) * 67108864.0::DOUBLE + (k[2 * j + 2] >> 6)) / 9007199254740992.0::DOUBLE AS u FROM bits4, range(312) r(j)
)"""
PLAN = f"""RECURSIVE {WEIGHTS}, {DRAWS}, bounds AS (
  SELECT source_id, sum(round(share, 9)) OVER (ORDER BY source_id) AS upto, sum(round(share, 9)) OVER () AS total, row_number() OVER (ORDER BY source_id) = count(*) OVER () AS last FROM weights
), low AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY source_id), 0) AS low FROM bounds
), every AS (
  SELECT chunk_id::BIGINT AS chunk_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - 1 AS rank FROM u JOIN low ON u * total >= low AND (u * total < upto OR last)
), drawn AS (SELECT greatest({CHUNKS}, max(chunk_id) + 1) AS n FROM every JOIN weights USING (source_id) WHERE rank = ceil(tokens / {CHUNK}) - 1
), plan AS (SELECT chunk_id, source_id, rank FROM every WHERE chunk_id < (SELECT n FROM drawn)
)"""
STREAM = f"""{PLAN}, needed AS (SELECT p.source_id, tokens, unnest(range(0, (((max(rank) + 1) * {CHUNK} - 1) // tokens) + 1)) AS epoch FROM plan p JOIN weights USING (source_id) GROUP BY p.source_id, tokens
), stream AS (
  SELECT source_id, epoch::INT AS epoch, doc_seq, n_tokens,
    (sum(n_tokens) OVER (PARTITION BY source_id, epoch ORDER BY sha256('{SEED}|' || source_id || '|' || epoch || '|' || doc_seq), doc_seq) + epoch * tokens)::BIGINT AS e FROM len JOIN needed USING (source_id)
), pieces AS (
  SELECT chunk_id, p.source_id, epoch, doc_seq, (greatest(e - n_tokens, rank * {CHUNK}) - (e - n_tokens))::BIGINT AS doc_offset, (greatest(e - n_tokens, rank * {CHUNK}) - rank * {CHUNK})::BIGINT AS chunk_offset,
    (least(e, (rank + 1) * {CHUNK}) - greatest(e - n_tokens, rank * {CHUNK}))::BIGINT AS n_tokens
  FROM plan p JOIN stream s ON s.source_id = p.source_id AND e - n_tokens < (rank + 1) * {CHUNK} AND rank * {CHUNK} < e
)"""
SQL["interleave_schedule"] = f"WITH {PLAN} SELECT chunk_id, source_id, rank FROM plan"
SQL["chunk_assembly"] = f"WITH {STREAM} SELECT chunk_id, source_id, epoch, doc_seq, doc_offset, chunk_offset, n_tokens FROM pieces"
SQL["first_locations"] = f"WITH {STREAM} SELECT chunk_id, source_id, epoch, doc_seq, doc_offset FROM pieces WHERE chunk_offset = 0"
SQL["source_accounting"] = f"""
WITH {STREAM}, read AS (SELECT source_id, count(*) AS chunks, (count(*) * {CHUNK})::BIGINT AS tokens FROM plan GROUP BY ALL)
SELECT source_id, tokens, chunks, count(*) FILTER (e <= tokens) AS documents_completed FROM read JOIN stream USING (source_id) GROUP BY ALL
"""
STEPS = f"""{PLAN}, touched AS (SELECT chunk_id, source_id, unnest(range(chunk_id * {CHUNK} // {STEP}, ((chunk_id + 1) * {CHUNK} - 1) // {STEP} + 1)) AS step FROM plan
), steps AS (
  SELECT step, source_id, sum(least((chunk_id + 1) * {CHUNK}, (step + 1) * {STEP}) - greatest(chunk_id * {CHUNK}, step * {STEP}))::BIGINT AS tokens FROM touched GROUP BY ALL
)"""
SQL["step_composition"] = f"WITH {STEPS} SELECT step, source_id, tokens FROM steps"
SQL["major_coverage"] = f"WITH {STEPS} SELECT source_id FROM weights WHERE share >= 0.01 AND source_id NOT IN (SELECT source_id FROM steps WHERE step < {COVERAGE_STEPS})"
SQL["sequence_pieces"] = f"""
WITH {STREAM}, s AS (SELECT *, chunk_id * {CHUNK} + chunk_offset AS place_ FROM pieces),
t AS (SELECT *, unnest(range(place_ // 1024, (place_ + n_tokens - 1) // 1024 + 1)) AS seq_id FROM s)
SELECT seq_id, greatest(place_, seq_id * 1024) - seq_id * 1024 AS seq_offset, source_id, epoch, doc_seq, doc_offset + greatest(place_, seq_id * 1024) - place_ AS doc_offset,
  least(place_ + n_tokens, (seq_id + 1) * 1024) - greatest(place_, seq_id * 1024) AS n_tokens FROM t
"""

ROWS = f"""{TOKENS}, flat AS (SELECT source_id, doc_seq, unnest(range(0, len(tokens))) AS i, unnest(tokens) AS token FROM tok
), placed AS (SELECT source_id, token, row_number() OVER (PARTITION BY source_id ORDER BY doc_seq, i) - 1 AS place_, count(*) OVER (PARTITION BY source_id) AS n FROM flat
), rows_ AS (SELECT source_id, place_ // {LENGTH} AS row, place_ % {LENGTH} AS pos, token FROM placed WHERE place_ // {LENGTH} < n // {LENGTH}
), st AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY source_id, row ORDER BY pos) = 4, true) AS is_start FROM rows_
), seg AS (SELECT *, (sum(is_start::INT) OVER (PARTITION BY source_id, row ORDER BY pos))::BIGINT AS segment FROM st)"""
SQL["packed_rows"] = f"WITH {ROWS} SELECT source_id, row, pos, token FROM rows_"
SQL["segment_ids"] = f"WITH {ROWS} SELECT source_id, row, pos, segment FROM seg"
SQL["masked_targets"] = f"""
WITH {ROWS}, n AS (SELECT *, lead(token) OVER (PARTITION BY source_id, row ORDER BY pos) AS f FROM rows_),
t AS (SELECT source_id, row, CASE WHEN token = 4 THEN -100 ELSE f END AS target FROM n WHERE f IS NOT NULL)
SELECT source_id, row, sum(target)::BIGINT AS targets, count(*) FILTER (target = -100) AS ignored, count(*) AS positions FROM t GROUP BY ALL
"""
SQL["mtp_triples"] = f"""
WITH {ROWS}, n AS (SELECT *, lead(token) OVER (PARTITION BY source_id, row ORDER BY pos) AS f, lead(token, 2) OVER (PARTITION BY source_id, row ORDER BY pos) AS g FROM rows_),
t AS (SELECT source_id, row, token, f, CASE WHEN token = 4 OR f = 4 THEN -100 ELSE g END AS target FROM n WHERE g IS NOT NULL)
SELECT source_id, row, sum(target)::BIGINT AS targets, sum(token::BIGINT * f)::BIGINT AS products, count(*) FILTER (target = -100) AS ignored FROM t GROUP BY ALL
"""
SQL["cu_seqlens"] = f"""
WITH {ROWS} SELECT source_id, row * {LENGTH} + pos AS "offset" FROM st WHERE is_start UNION ALL SELECT source_id, max(row * {LENGTH} + pos) + 1 FROM rows_ GROUP BY ALL
"""
SQL["document_mask"] = f"""
WITH {ROWS} SELECT a.source_id, a.row, count(*) AS pairs, sum(b.pos)::BIGINT AS keys FROM seg a JOIN seg b ON a.source_id = b.source_id AND a.row = b.row AND a.segment = b.segment AND b.pos <= a.pos GROUP BY ALL
"""
_lags = " + ".join(f"coalesce(CASE WHEN segment = lag(segment, {k}) OVER w THEN lag(token, {k}) OVER w * {x} ELSE 0 END, 0)" for k, x in enumerate(MTP_WEIGHTS))
SQL["lagged_sum"] = f"""
WITH {ROWS}, l AS (SELECT source_id, row, {_lags} AS v FROM seg WINDOW w AS (PARTITION BY source_id, row ORDER BY pos))
SELECT source_id, row, round(sum(v::DOUBLE), 3) AS lagged FROM l GROUP BY ALL
"""
SQL["segment_boundaries"] = f"WITH {ROWS} SELECT source_id, row, max(segment) - 1 AS boundaries FROM seg GROUP BY ALL"

VALUES = "v AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _stats(v: str) -> str:
    q = ", ".join(f"round(quantile_cont({v}, {p}), 6) AS {n}" for n, p in (("p01", 0.01), ("p10", 0.1), ("median", 0.5), ("p90", 0.9), ("p99", 0.99)))
    return f"count(*) AS numel, round(count(*) FILTER (isfinite({v})) / count(*), 6) AS finite_fraction, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(sqrt(avg({v} * {v})), 6) AS rms, round(min({v}), 6) AS min, round(max({v}), 6) AS max, {q}"


SQL["tensor_stats"] = f"WITH {VALUES} SELECT label, {_stats('v')} FROM v GROUP BY ALL"
SQL["buffer_stats"] = SQL["tensor_stats"]
SQL["gate_stats"] = f"""
WITH {VALUES}, g AS (SELECT label, 1 / (1 + exp(-v * 4)) AS v FROM v)
SELECT label, {_stats('v')}, round(avg((v < 0.01)::INT), 6) AS saturation_low, round(avg((v > 0.99)::INT), 6) AS saturation_high FROM g GROUP BY ALL
"""
SQL["optimizer_summary"] = f"""
WITH {VALUES} SELECT CASE WHEN i < 32 THEN 'momentum' ELSE 'variance' END AS name, count(DISTINCT vec_id) AS tensor_count, count(*) AS numel, round(count(*) FILTER (isfinite(v)) / count(*), 6) AS finite_fraction,
  round(sqrt(sum(v * v) / count(*)), 6) AS rms, round(max(abs(v)), 6) AS max_abs FROM v GROUP BY ALL
"""
SQL["head_variation"] = f"""
WITH {VALUES}, h AS (SELECT label, vec_id, sqrt(avg(v * v)) AS r FROM v GROUP BY ALL)
SELECT label, round(stddev_pop(r) / greatest(avg(r), 1e-30), 6) AS variation FROM h GROUP BY ALL
"""
SQL["route_stats"] = f"""
WITH {VALUES}, p AS (SELECT vec_id, v, exp(v) AS w, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM v)
SELECT vec_id, count(*) AS source_count, round(-sum(p * ln(greatest(p, 1e-30))), 6) AS entropy, round(max(p), 6) AS max_weight, round(sqrt(avg(v * v)), 6) AS added_rms, round(sqrt(avg(w * w)), 6) AS residual_rms,
  round(sqrt(avg(v * v)) / greatest(sqrt(avg(w * w)), 1e-30), 6) AS ratio FROM p GROUP BY ALL
"""
SQL["vector_similarity"] = """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine,
  round(abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) / greatest(abs(a.embedding[1]::DOUBLE), 1e-30), 5) AS relative_error FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""
MEASURED = """m AS (
  SELECT event_type AS source, avg(abs(value) / 100) AS nll, avg((event_id % 3 = 0)::INT) AS top1_accuracy, avg(value / 7) AS correct_token_margin,
    quantile_cont(abs(value) / 100, 0.1) AS nll_p10, quantile_cont(abs(value) / 100, 0.9) AS nll_p90, count(*) AS tokens FROM events WHERE value IS NOT NULL GROUP BY ALL
)"""
SQL["source_metrics"] = f"""
WITH {MEASURED} SELECT source, round(nll, 6) AS nll, round(top1_accuracy, 6) AS top1_accuracy, round(correct_token_margin, 6) AS correct_token_margin, round(nll_p10, 6) AS nll_p10, round(nll_p90, 6) AS nll_p90,
  round(exp(least(nll, 20)), 6) AS perplexity, tokens FROM m
"""
SQL["weighted_validation"] = f"""
WITH {MEASURED}, w AS (SELECT *, CASE WHEN length(source) % 2 = 0 THEN length(source) ELSE 1 END::DOUBLE AS w FROM m)
SELECT round(sum(w * nll) / sum(w), 6) AS nll, round(sum(w * top1_accuracy) / sum(w), 6) AS top1_accuracy, round(sum(w * correct_token_margin) / sum(w), 6) AS correct_token_margin,
  round(sum(w * nll_p10) / sum(w), 6) AS nll_p10, round(sum(w * nll_p90) / sum(w), 6) AS nll_p90, sum(w) AS weight_sum, sum(tokens)::BIGINT AS tokens, round(exp(least(sum(w * nll) / sum(w), 20)), 6) AS perplexity FROM w
"""
SQL["validation_nll"] = f"""
WITH w AS (SELECT event_id // 500 AS shard, event_id // 10 % 50 AS win, sum(abs(value)) AS loss_sum, count(*) AS valid FROM events GROUP BY ALL),
r AS (SELECT *, sum(valid) OVER (ORDER BY shard, win) - valid AS before FROM w),
p AS (SELECT 's' || shard % 4 AS source, sum(loss_sum) / sum(valid) AS nll, sum(valid) AS tokens FROM r WHERE before < {VALID} GROUP BY ALL)
SELECT round(sum(tokens * nll) / sum(tokens), 5) AS weighted_nll, sum(tokens)::BIGINT AS validation_tokens, count(*) AS sources FROM p
"""
SQL["validation_by_source"] = f"""
WITH w AS (SELECT event_id // 500 AS shard, event_id // 10 % 50 AS win, sum(abs(value)) AS loss_sum, count(*) AS valid FROM events GROUP BY ALL),
r AS (SELECT *, sum(valid) OVER (ORDER BY shard, win) - valid AS before FROM w),
p AS (SELECT 's' || shard % 4 AS source, sum(loss_sum) / sum(valid) AS nll, sum(valid)::BIGINT AS tokens FROM r WHERE before < {VALID} GROUP BY ALL)
SELECT source, round(nll, 5) AS nll, tokens, round(tokens / sum(tokens) OVER (), 5) AS weight FROM p
"""
SQL["steady_throughput"] = """
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, round(median(value) FILTER (k > 1), 6) AS steady_median, round(avg(value) FILTER (k > 1), 6) AS steady_mean, round(max(value), 6) AS peak, bool_and(value IS NOT NULL AND isfinite(value)) AS all_finite, count(*) AS steps,
  round(95 - max(value), 6) AS headroom, max(value) <= 95 AS within_limit FROM n GROUP BY ALL
"""
SQL["recent_records"] = f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= {RECENT}"
SQL["lr_schedule"] = """
WITH o AS (SELECT o_orderkey, o_orderkey // 4 AS step FROM orders)
SELECT o_orderkey, step, round(CASE WHEN step < 200 THEN 3e-4 * (step + 1) / 200 ELSE 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * greatest(0, least(1, (step - 200) / 2800)))) END, 10) AS lr FROM o
"""
_types = ", ".join(f"coalesce(sum(p_size) FILTER (p_type = '{t}'), 0)::BIGINT AS \"{t}\"" for t in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))
SQL["parameter_report"] = f"SELECT {_types}, sum(p_size)::BIGINT AS total FROM part"
SQL["target_steps"] = "SELECT o_orderkey, ((o_orderkey * 1000003 + 1) + 65535) // 65536 AS steps FROM orders"
SQL["activations"] = """
SELECT event_id, round(4 * tanh(value / 50 / 4) / (1 + exp(-value / 50)), 5) AS gate, round(25 * tanh(value / 50 / 25), 5) AS softcap, round(exp(least(value / 50, 20)), 5) AS perplexity FROM events WHERE value IS NOT NULL
"""
SQL["compare_screen"] = """
WITH g AS (SELECT o_orderkey // 8 AS pair, o_orderkey % 2 AS side, max(o_orderkey) AS k, round(max(o_totalprice) / 1000, 0) AS nll FROM orders GROUP BY ALL),
f AS (SELECT *, pair // 4 * 200000 + 60000000 AS tokens, CASE WHEN k % 11 = 0 OR k % 17 = 0 THEN 'incomplete' WHEN k % 13 = 0 THEN 'no full validation' END AS fault FROM g),
j AS (SELECT a.pair, a.tokens, a.nll AS x, b.nll AS y, coalesce(a.fault, b.fault, CASE WHEN a.tokens < 67108864 THEN 'too few tokens' END) AS fault FROM f a JOIN f b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)
SELECT pair, tokens AS tokens_per_arm, CASE WHEN fault IS NULL THEN CASE WHEN x = y THEN 'inconclusive' WHEN y < x THEN 'routed' ELSE 'normal' END END AS winner, fault FROM j
"""
SQL["contract_mismatch"] = """
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS left_value FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS right_value FROM orders)
SELECT o_orderkey, left_value, right_value FROM a FULL JOIN b USING (o_orderkey) WHERE left_value IS DISTINCT FROM right_value
"""
SQL["retain_latest"] = """
WITH n AS (SELECT DISTINCT o_custkey, 'step_' || lpad((o_orderkey % 1000)::VARCHAR, 8, '0') AS name FROM orders)
SELECT o_custkey, name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY name = 'step_00000000', name DESC) AS k FROM n) WHERE k <= 2 OR name = 'step_00000000'
"""
SQL["latest_validation"] = """
SELECT o_custkey, max('validation_final_step' || lpad(o_orderkey::VARCHAR, 8, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '_diagnostic.json' ELSE '.json' END) AS name FROM orders GROUP BY ALL
"""
SQL["missing_weights"] = f"WITH {SHARDS} SELECT DISTINCT source_id FROM shards WHERE source_id NOT IN (SELECT source_id FROM shards WHERE split = 'validation' AND documents % 2 = 1)"


def _cut(i: int) -> str:
    return f"array_to_string(w[{4 * i + 1}:{4 * i + 4}], ' ')"


def _letters(i: int) -> str:
    return f"trim(regexp_replace({_cut(i)}, '[^A-Za-z ]', '', 'g'))"


def _joined(*parts: str, between: str = "' '") -> str:
    return f" || {between} || ".join(parts)


_EXAMPLES = {
    "jcommonsenseqa": (_joined(*map(_cut, range(6))), "", ""), "jnli": (_joined(_cut(0), _cut(1)), "", ""), "jmmlu": (_joined(*map(_cut, range(5))), "", ""),
    "jsquad_context": (_cut(0), "", ""), "jsquad_qa": (f"trim({_joined(*map(_cut, (1, 2, 3)))}, ' ' || chr(10))", "", ""), "niilc": (f"array_to_string(list_filter([{', '.join(map(_letters, range(3)))}], lambda t: t <> ''), ' ')", "", ""),
    "gsm8k": (_joined(_cut(0), _cut(1)), "question", "answer"), "humaneval": (_joined(_cut(0), _cut(1), between="chr(10)"), "prompt", "solution"), "mbpp": (_joined(_cut(0), _cut(1), between="chr(10)"), "prompt", "solution"),
}
_WORDS_OF = "WITH b AS (SELECT string_split(text, ' ') AS w FROM benchmark)"
SQL["canonical_records"] = f"{_WORDS_OF} " + " UNION ALL ".join(f"SELECT '{b}' AS benchmark, {x} AS text FROM b" + (f" WHERE {_letters(0)} <> ''" if b == "niilc" else "") for b, (x, _, _) in _EXAMPLES.items())
SQL["canonical_parts"] = f"{_WORDS_OF} " + " UNION ALL ".join(
    f"SELECT '{b}_{first}' AS benchmark, {_cut(0)} AS text FROM b UNION ALL SELECT '{b}_{second}', {_cut(1)} FROM b" if first else f"SELECT '{b}' AS benchmark, {x} AS text FROM b" + (f" WHERE {_letters(0)} <> ''" if b == "niilc" else "")
    for b, (x, first, second) in _EXAMPLES.items()
)
SQL["record_lines"] = r"""
WITH l AS (SELECT doc_id, string_split_regex(replace(replace(text, '.', chr(11)), ',', chr(8232)), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS t FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(t))) AS line, unnest(t) AS text FROM l)
SELECT doc_id, line::BIGINT AS line, text FROM e WHERE regexp_replace(text, '\s+', '', 'g') <> ''
"""
_names = "[" + ", ".join(f"'{b}'" for b in RULES) + "]"
_values = ", ".join(f"('{b}', {c}, {r}, {u}, {str(s).lower()})" for b, (c, r, u, s) in RULES.items())
SQL["rule_decisions"] = f"""
WITH {FINDINGS.rsplit('), decided', 1)[0]}), rules(benchmark, c, r, u, s) AS (VALUES {_values}),
named AS (SELECT *, {_names}[record_id % {len(RULES)} + 1] AS benchmark FROM f)
SELECT doc_id, record_id, benchmark, s AND substring AS substring,
  (s AND substring) OR (coverage >= c AND (r = 0 OR contiguous_fraction >= r)) OR (u > 0 AND contiguous_units >= u) AS contaminated FROM named JOIN rules USING (benchmark)
"""
SQL["stored_gram_index"] = SQL["contamination_word_span"]
SQL["stored_record_index"] = f"""
WITH {RECORDS} SELECT record_id, length(key) AS record_chars, greatest(CASE WHEN cjk THEN length(c) - 19 ELSE len(w) - 12 END, 0)::BIGINT AS record_ngrams FROM rec
"""
SQL["controlled_stop"] = f"""
WITH bad AS (SELECT user_id, min(event_id) AS b FROM events WHERE value > 250 OR value IS NULL GROUP BY ALL),
good AS (SELECT e.user_id, event_id, event_id % 7 + 1 AS tokens, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id DESC) AS k FROM events e JOIN bad USING (user_id) WHERE event_id < b),
done AS (SELECT user_id, max(event_id) AS step, sum(tokens)::BIGINT AS tokens_done, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (k <= {RECENT}) AS recent FROM good GROUP BY ALL)
SELECT user_id, 'controlled_nonfinite_stop' AS status, coalesce(step, 0) AS step, coalesce(tokens_done, 0) AS tokens_done,
  'step_' || CASE WHEN length(coalesce(step, 0)::VARCHAR) < 8 THEN lpad(coalesce(step, 0)::VARCHAR, 8, '0') ELSE step::VARCHAR END || '_diagnostic' AS resumable_checkpoint, coalesce(recent, '') AS recent_successful_steps
FROM bad LEFT JOIN done USING (user_id)
"""
SQL["source_maps"] = f"""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, '{{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS chunks,
  '{{' || string_agg('"' || event_type || '":' || n * {CHUNK}, ',' ORDER BY event_type) || '}}' AS tokens FROM n GROUP BY user_id
"""
SQL["run_options"] = """
WITH w AS (SELECT o_orderkey, ['train', '--seed', o_orderkey::VARCHAR] || CASE WHEN o_orderkey % 3 = 0 THEN ['--lr=' || o_orderkey, 'x'] ELSE ['--lrs', 'y'] END
  || CASE WHEN o_orderkey % 2 = 0 THEN ['--lr', '2', 'z'] ELSE [] END AS l FROM orders),
e AS (SELECT o_orderkey, unnest(l) AS t, unnest(range(len(l))) AS i, unnest([''] || l[:-2]) AS before FROM w),
r AS (SELECT o_orderkey, string_agg(CASE WHEN t = '--lr' OR starts_with(t, '--lr=') THEN '--lr 0.5' ELSE t END, ' ' ORDER BY i) FILTER (before <> '--lr') AS l, bool_or(t = '--lr' OR starts_with(t, '--lr=')) AS found FROM e GROUP BY ALL)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR WHEN o_orderkey % 2 = 0 THEN '2' ELSE 'none' END AS lr, o_orderkey::VARCHAR AS seed, l || CASE WHEN found THEN '' ELSE ' --lr 0.5' END AS words FROM r
"""
