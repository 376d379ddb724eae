import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import interleave as I
from millrace.operators import packing, segments
from millrace.plans import catalogue


def test_published_share_of_the_schedule(spark):
    sources = spark.createDataFrame([("jpnmix", 0.358584), ("local", 0.641416)], "source_id string, weight double")
    plan = I.schedule(spark, sources, 11, 800)
    assert plan.where("source_id = 'local'").count() == 529
    per = I.composition(plan, 8192, 65536).groupBy("step").agg(F.count("*").alias("n"))
    assert per.count() == 100 and per.where("n = 2").count() == 95


def walk(docs, picks, chunk, order):
    """Chunks by stepping a cursor through each source's documents, epoch after epoch."""
    cursors, out, done = {s: [0, 0, 0] for s in docs}, [], {s: 0 for s in docs}
    for n, s in enumerate(picks):
        left, got = chunk, []
        while left:
            epoch, place, at = cursors[s]
            names = order(s, epoch)
            if place == len(names):
                cursors[s] = [epoch + 1, 0, 0]
                continue
            d = names[place]
            have = docs[s][d] - at
            take = min(have, left)
            if take:
                got.append((n, s, epoch, d, at, chunk - left, take))
            left -= take
            if at + take == docs[s][d]:
                cursors[s] = [epoch, place + 1, 0]
                done[s] += 1
            else:
                cursors[s] = [epoch, place, at + take]
        out += got
    return out, done


@pytest.mark.parametrize("chunk", [1, 5, 10])
def test_closed_form_equals_a_cursor(spark, chunk):
    docs = {"alpha": {0: 3, 1: 2, 2: 0, 3: 4}, "beta": {0: 2, 1: 3, 2: 1, 3: 2}, "long": {0: 20, 1: 20}}
    lengths = spark.createDataFrame([(s, d, n) for s, x in docs.items() for d, n in x.items()], "source_id string, doc_seq long, n_tokens long")
    sources = spark.createDataFrame([("alpha", 0.5), ("beta", 0.3), ("long", 0.2)], "source_id string, weight double")
    plan = I.schedule(spark, sources, 7, 60)
    stream = I.streams(lengths, plan, chunk, I.portable_order(7))
    import hashlib

    order = lambda s, e: sorted(docs[s], key=lambda d: (hashlib.sha256(f"7|{s}|{e}|{d}".encode()).hexdigest(), d))
    r = random.Random(7)
    picks = []
    for _ in range(60):
        u = r.random() * 1.0
        picks.append("alpha" if u < 0.5 else "beta" if u < 0.8 else "long")
    want, done = walk(docs, picks, chunk, order)
    parts = I.pieces(stream, plan, chunk)
    assert sorted(map(tuple, parts.collect())) == sorted(want)
    got = {x.source_id: x for x in I.accounting(stream, plan, chunk).collect()}
    assert {s: x.documents_completed for s, x in got.items()} == {s: done[s] for s in got}
    seq = I.sequences(parts, chunk, 7).groupBy("seq_id").agg(F.sum("n_tokens").alias("n")).orderBy("seq_id").collect()
    assert [x.n for x in seq[:-1]] == [7] * (len(seq) - 1)
    resumed = plan.where("chunk_id >= 37")
    assert sorted(map(tuple, I.pieces(stream, resumed, chunk).collect())) == sorted(x for x in want if x[0] >= 37)


def test_token_chunks_are_full(spark):
    tokens = spark.createDataFrame([("a", 0, [1, 2, 3]), ("a", 1, [4, 5])], "source_id string, doc_seq long, tokens array<int>").withColumn("n_tokens", F.size("tokens").cast("long"))
    plan = I.schedule(spark, spark.createDataFrame([("a", 1.0)], "source_id string, weight double"), 1, 5)
    parts = I.pieces(I.streams(tokens.drop("tokens"), plan, 4, I.portable_order(1)), plan, 4)
    chunks = I.token_chunks(parts, tokens).orderBy("chunk_id").collect()
    assert [len(c.tokens) for c in chunks] == [4] * 5
    flat = [t for c in chunks for t in c.tokens]
    assert all(sorted(flat[k : k + 5]) == [1, 2, 3, 4, 5] for k in range(0, 20, 5))


def test_permutations_and_seeds():
    assert sorted(I.permutation(11, "local", 0, "shards", 9).tolist()) == list(range(9))
    assert I.derived_seed(11, "local", 0, "shards") != I.derived_seed(11, "local", 1, "shards")


def test_major_gate_and_alignment(spark):
    sources = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "source_id string, major boolean")
    steps = spark.createDataFrame([(0, "a", 5), (150, "b", 5)], "step long, source_id string, tokens long")
    assert [r.source_id for r in I.missing_majors(steps, sources).collect()] == ["b"]
    rows = spark.createDataFrame([(160, 32, 2, 128), (160, 30, 2, 128), (160, 32, 3, 128)], "r long, p long, s long, d long")
    got = [x[0] for x in rows.select(I.alignment(F.col("r"), F.col("p"), F.col("s"), F.col("d"), 64)).collect()]
    assert got == [None, "data cursor differs", "step and tokens differ"]


def test_segments_never_cross_an_end_of_document(spark):
    ids = [9, 8, 7, 4, 6, 5, 4, 4]
    rows = spark.createDataFrame([("s", 0, k, t) for k, t in enumerate(ids)], "source_id string, row long, pos long, token int")
    assert [r.segment for r in segments.with_segments(rows).orderBy("pos").collect()] == [1, 1, 1, 1, 2, 2, 2, 3]
    assert [r.target for r in segments.with_targets(rows).orderBy("pos").collect()] == [8, 7, 4, -100, 5, 4, -100]
    assert [r.target for r in segments.triples(rows).orderBy("pos").collect()] == [7, 4, -100, -100, 4, -100]
    assert [r.offset for r in segments.cu_seqlens(rows, 8).orderBy("offset").collect()] == [0, 4, 7, 8]
    assert segments.mask_pairs(rows).count() == 10 + 6 + 1
    listed = segments.mask_pairs(rows).groupBy("source_id", "row").agg(F.count("*").alias("pairs"), F.sum("k").alias("keys_sum"))
    assert sorted(map(tuple, segments.mask_sizes(rows).collect())) == sorted(map(tuple, listed.collect()))
    assert segments.boundaries(rows).first().boundaries == 2


def test_packing_checks(spark):
    df = spark.createDataFrame([("ok", 1, "a b"), ("ok", 2, ""), ("ok", 3, None)], "source string, id long, text string")
    rows = packing.tokenised(df, "source", "id", "text").collect()
    assert len(rows) == 1 and rows[0].n_tokens == 3 and rows[0].tokens[-1] == 4
    with pytest.raises(Exception, match="not a source id"):
        packing.tokenised(spark.createDataFrame([("-bad", 1, "a")], "source string, id long, text string"), "source", "id", "text").collect()
    bad = spark.createDataFrame([("a", 0.0, True, 5), ("a", 1.0, None, 5), ("", 1.0, True, 0)], "source_id string, weight double, major boolean, tokens long")
    assert packing.violations(bad).count() == 6


def test_draws_in_blocks_are_the_same_numbers(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 700)  # the generator's state turns over every 312 draws
    got = I.drawn(spark, 11, 2000).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(2000)) and [r.u for r in got] == I.draws(11, 2000)


def test_draws_until_every_source_has_given_all(monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    picks = ["ab"[u * 1.0 >= 0.9] for u in I.draws(3, 1000)]
    n = I.draws_for_all([95, 41], [0.9, 0.1], 3, 10)
    assert picks[:n].count("a") >= 10 and picks[:n].count("b") >= 5 and min(picks[: n - 1].count("a") - 10, picks[: n - 1].count("b") - 5) < 0
    assert I.draws_for_all([95, 41], [0.9, 0.1], 3, 10, 400) == 400
    with pytest.raises(ValueError, match="positive"):
        I.draws_for_all([95, 1], [1.0, 0.0], 3, 10)


def test_every_token_is_in_a_chunk_and_a_sequence(spark, tmp_path):
    docs = [(k, "w " * 2999, "a" if k % 8 else "b") for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    total = 400 * 3000
    for name in ("chunk_assembly", "sequence_pieces"):
        first = catalogue.QUERIES[name](spark, str(tmp_path)).where("epoch = 0").agg(F.sum("n_tokens"), F.countDistinct("doc_seq")).first()
        assert tuple(first) == (total, 400)
    done = catalogue.QUERIES["source_accounting"](spark, str(tmp_path)).collect()
    assert all(r.documents_completed >= n for r, n in zip(sorted(done), (350, 50), strict=True))
