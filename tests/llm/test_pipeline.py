import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_classifiers import brute_statistics
from test_jaccard_join import brute

from millrace.llm import bpe, jaccard_join


def corpus():
    r = random.Random(9)
    words = [f"word{k}" for k in range(300)]
    item = " ".join(f"bench{k}" for k in range(30))
    rows = [(i, " ".join(r.choice(words) for _ in range(80)), "en", "s", 0) for i in range(12)]
    rows += [(20, rows[3][1], "en", "s", 0), (21, rows[4][1].replace("word1 ", "other ", 1), "en", "t", 0), (22, "too short", "en", "s", 0), (23, None, None, None, None), (24, "same three words " * 30, "en", "s", 0)]
    rows += [(25, rows[5][1] + " " + item, "en", "s", 0), (26, " ".join(reversed(rows[6][1].split())) + ' token = "abcdefgh12345678" end', "en", "s", 0)]
    return [(d, t, x, s, None if t is None else len(t)) for d, t, x, s, _ in rows], item


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = []
    for d, t, *_ in rows:
        n, _, _, _, again = brute_statistics(t or "")
        if n >= 50 and 100 * again <= 50 * n:
            kept.append((d, t))
    kept = [(d, t) for d, t in kept if (d, d) in {(x, c) for x, _, c in brute(kept, jaccard_join.NEAR)}]
    kept = {d: t.replace('token = "abcdefgh12345678', "[assign]") for d, t in kept if item not in t}
    assert set(got) == set(kept) and {20, 22, 23, 24, 25}.isdisjoint(got) and "[assign]" in kept[26]
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    for d, t in kept.items():
        assert np.frombuffer(got[d].ids, "<u4").tolist() == c.encode(t) and got[d].decodes


def test_stages_keep_the_columns(spark, tmp_path):
    rows, item = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = docs.withColumns({c: F.lit(c) for c in ("n_words", "kept", "rule", "matches", "spans", "blob", "node", "place", "__text")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        more = stage(spark, odd, str(tmp_path))
        assert more.dtypes == odd.dtypes and more.count() == out.count()
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).collect() == []
