"""The stream of chunks in the two-level order: jumps of the generator, orders made in tasks, restarts, refused contracts."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import twister
from millrace.operators import interleave as I
from millrace.operators import orders, packing
from millrace.plans import catalogue
from millrace.plans.settings import CHUNK, SEED
from millrace.sources.interleaved import InterleavedSource, Streams, fingerprint, sources_of
from millrace.sources.shards import ShardSource, named_source

LENGTHS = {"beta": [[4, 0, 3], [5], [1, 1, 1, 7]], "alpha": [[2, 9], [0, 0], [3, 3, 3]], "long": [[40, 41], [13]]}
WEIGHTS = {"beta": 0.5, "alpha": 0.3, "long": 0.2}


def folder(path, canonical=True):
    """Shards whose tokens count up, so that every place is known by its token."""
    path.mkdir()
    token, sources, flat = 0, [], []
    for s, shards in LENGTHS.items():
        listed = []
        for k, docs in enumerate(shards):
            name, n = f"{s}-train-{k:05d}", sum(docs)
            np.arange(token, token + n, dtype="<u2").tofile(path / f"{name}.bin")
            np.array([0, *np.cumsum(docs)], dtype="<u8").tofile(path / f"{name}.idx")
            listed.append({"path": f"{name}.bin", "index": f"{name}.idx", "tokens": n, "documents": len(docs)})
            token += n
        sources.append({"source_id": s, "weight": WEIGHTS[s], "major": True, "shards": listed})
        flat += listed
    manifest = {"interleave": {"sources": sources}} if canonical else {"format": "document-indexed-uint16-shards", "splits": {"train": {"shards": flat}}}
    (path / "manifest.json").write_text(json.dumps(manifest))
    return str(path)


def cursor(weights, seed, chunk, n, lengths=LENGTHS):
    """Chunks by stepping through shards, documents and epochs, one after the other: (source, pieces, first location)."""
    at, r, out = {s: [0, 0, 0, 0] for s in weights}, random.Random(seed), []
    for _ in range(n):
        u, upto = r.random() * sum(weights.values()), 0.0
        for s, w in weights.items():
            upto += w
            if u < upto:
                break
        left, got = chunk, []
        while left:
            epoch, k, d, offset = at[s]
            order = orders.shard_order(seed, s, epoch, len(lengths[s]))
            if k == len(order):
                at[s] = [epoch + 1, 0, 0, 0]
                continue
            shard = int(order[k])
            docs = orders.document_order(seed, s, epoch, shard, len(lengths[s][shard]))
            if d == len(docs):
                at[s] = [epoch, k + 1, 0, 0]
                continue
            have = lengths[s][shard][docs[d]] - offset
            take = min(have, left)
            if take:
                got.append((epoch, shard, int(docs[d]), offset, chunk - left, take))
            left -= take
            at[s] = [epoch, k, d, offset + take] if take < have else [epoch, k, d + 1, 0]
        out.append((s, got))
    return out


def first_tokens():
    """The first token of each document."""
    out, token = {}, 0
    for s, shards in LENGTHS.items():
        for k, docs in enumerate(shards):
            for d, n in enumerate(docs):
                out[s, k, d] = token
                token += n
    return out


def test_jumps_equal_steps():
    for seed, n in ((0, 0), (11, 1), (11, 311), (11, 313), (3, 20_000), (2**70, 123_457)):
        r = random.Random(seed)
        for _ in range(n):
            r.random()
        assert twister.after(seed, n).random_sample(700).tolist() == [r.random() for _ in range(700)]
    far = twister.after(5, 10**15).random_sample(3)
    near = twister.after(5, 10**15 - 1000).random_sample(1003)
    assert far.tolist() == near[1000:].tolist()
    assert twister.characteristic().bit_count() == 135  # a published property of this generator


def test_picks_by_block_and_the_stop_rule(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 100)
    weights = [0.9, 0.0995, 0.0005]
    picks = I.pick(weights)(np.array(I.draws(11, 1050))).tolist()
    got = {(r.block, r.source): (r.picks, r.before) for r in I.picks_of_blocks(spark, weights, 11, 1050).collect()}
    assert got == {(b, s): (picks[100 * b : 100 * (b + 1)].count(s), picks[: 100 * b].count(s)) for b in range(11) for s in range(3)}
    n = I.draws_for_all([9000, 50, 30], weights, 11, 10)
    picks = I.pick(weights)(np.array(I.draws(11, n))).tolist()
    assert picks.count(0) >= 900 and picks.count(1) >= 5 and picks.count(2) >= 3
    assert picks[:-1].count(2) == 2 or picks[:-1].count(0) == 899 or picks[:-1].count(1) == 4
    assert I.draws_for_all([0, 0, 0], weights, 11, 10, 7) == 7


@pytest.mark.parametrize("chunk", [1, 6, 50])
def test_two_level_order_equals_a_cursor(spark, chunk):
    rows = [(s, k, d, 1000 * k + d, n) for s, shards in LENGTHS.items() for k, docs in enumerate(shards) for d, n in enumerate(docs)]
    lengths = spark.createDataFrame(rows, "source_id string, shard int, place long, doc_seq long, n_tokens long")
    weights = dict(sorted(WEIGHTS.items()))
    plan = I.schedule(spark, spark.createDataFrame([*weights.items()], "source_id string, weight double"), 7, 90)
    parts = I.pieces(orders.streams(lengths, plan, chunk, 7), plan, chunk, ("shard", "place"))
    want = [(n, s, e, k, d, 1000 * k + d, o, c, t) for n, (s, got) in enumerate(cursor(weights, 7, chunk, 90)) for e, k, d, o, c, t in got]
    assert parts.columns == ["chunk_id", "source_id", "epoch", "shard", "place", "doc_seq", "doc_offset", "chunk_offset", "n_tokens"]
    assert sorted(map(tuple, parts.collect())) == sorted(want)


def test_shards_are_cut_at_documents(spark):
    docs = [("a", k, n) for k, n in enumerate((3, 3, 5, 30, 1, 1))] + [("b", 7, 2)]
    got = orders.in_shards(spark.createDataFrame(docs, "source_id string, doc_seq long, n_tokens long"), 10).orderBy("source_id", "doc_seq").collect()
    assert [(r.shard, r.place) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (0, 0)]


def run(spark, path, tmp, **options):
    """One run of the stream: a batch, if there is one left."""
    spark.dataSource.register(InterleavedSource)
    said = {"path": path, "seed": 7, "chunk": 6, "chunks": 40, "batch": 9, "tasks": 2} | options
    q = spark.readStream.format("interleaved_tokens").options(**said).load().writeStream.format("parquet").option("checkpointLocation", str(tmp / "checkpoint")).option("path", str(tmp / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_stream_resumes_at_any_chunk(spark, tmp_path):
    path = folder(tmp_path / "data")
    starts, counts = first_tokens(), []
    for _ in range(6):
        run(spark, path, tmp_path)
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts == [9, 18, 27, 36, 40, 40]
    got = {r.chunk_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == list(range(40))
    for n, (s, parts) in enumerate(cursor(WEIGHTS, 7, 6, 40)):
        tokens = [t for _, k, d, o, _, m in parts for t in range(starts[s, k, d] + o, starts[s, k, d] + o + m)]
        assert (got[n].source_id, got[n].tokens, (got[n].shard, got[n].document, got[n].offset)) == (s, tokens, parts[0][1:4])


@pytest.mark.parametrize("change", ["seed", "max_chunk_tokens", "source_fingerprint", "data_order_contract"])
def test_another_contract_is_refused(spark, tmp_path, change):
    path, options = folder(tmp_path / "data"), {}
    run(spark, path, tmp_path)
    if change == "seed":
        options = {"seed": 8}
    elif change == "max_chunk_tokens":
        options = {"chunk": 5}
    elif change == "source_fingerprint":
        m = json.loads((tmp_path / "data/manifest.json").read_text())
        m["interleave"]["sources"][0]["weight"] = 0.6
        (tmp_path / "data/manifest.json").write_text(json.dumps(m))
    else:
        last = tmp_path / "checkpoint/offsets/0"
        last.write_text(last.read_text().replace("source_balanced_interleave_v1", "another"))
        (tmp_path / "checkpoint/offsets/.0.crc").unlink()
    with pytest.raises(Exception, match=f"begun with another {change}"):
        run(spark, path, tmp_path, **options)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_stretches_don_t_matter(tmp_path):
    """A chunk is the same wherever a task begins, far into the stream too."""
    path = folder(tmp_path / "data")
    sources = sources_of(path)
    one, two = Streams(path, sources, 7, 6), Streams(path, sources, 7, 2)
    for source in range(3):
        for rank in (0, 5, 10_001):
            location, tokens = one.read(source, rank)
            parts = [two.read(source, 3 * rank + i) for i in range(3)]
            assert location == parts[0][0] and tokens.tolist() == [t for _, p in parts for t in p.tolist()]


def test_sources_by_name_and_bad_folders(tmp_path):
    canonical, named = sources_of(folder(tmp_path / "a")), sources_of(folder(tmp_path / "b", canonical=False))
    assert [s.source_id for s in canonical] == ["beta", "alpha", "long"] and [s.source_id for s in named] == ["alpha", "beta", "long"]
    assert sum(s.weight for s in named) == pytest.approx(1) and {s.source_id: s.tokens for s in named} == {s.source_id: s.tokens for s in canonical}
    assert fingerprint(canonical) != fingerprint(named)
    assert (named_source("x/jp-mix-train-00012.bin", "train"), named_source("local-1.bin", "train")) == ("jp-mix", "local")
    for damage, said in ((lambda m: m["interleave"]["sources"][0].pop("major"), "major"), (lambda m: m["interleave"]["sources"][1].update(weight=0), "positive"), (lambda m: m["interleave"]["sources"][0]["shards"][0].update(tokens=5), "the manifest says 5"), (lambda m: m["interleave"]["sources"][0]["shards"][0].update(path="../x.bin"), "inside its folder"), (lambda m: m["interleave"]["sources"].append(m["interleave"]["sources"][0]), "of its own")):
        m = json.loads((tmp_path / "a/manifest.json").read_text())
        damage(m)
        (tmp_path / "b/manifest.json").write_text(json.dumps(m))
        for f in (tmp_path / "a").glob("*-train-*"):
            (tmp_path / "b" / f.name).write_bytes(f.read_bytes())
        with pytest.raises(ValueError, match=said):
            sources_of(str(tmp_path / "b"))


@pytest.mark.parametrize("canonical", [True, False])
def test_shard_reader_takes_every_kind_of_manifest(spark, tmp_path, canonical):
    path = folder(tmp_path / "data", canonical)
    spark.dataSource.register(ShardSource)
    rows = spark.read.format("token_shards").option("split", "train").load(path)
    got = {(r.source_id, r.n, r.tokens) for r in rows.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens")).collect()}
    assert got == {(s, sum(map(len, x)), sum(map(sum, x))) for s, x in LENGTHS.items()}


SF = "/root/testdata/sf0.001"


def test_query_of_shard_orders_equals_a_cursor(spark):
    plan = catalogue.plan(spark, SF).orderBy("chunk_id").collect()
    shares = {r.source_id: round(r.weight, 9) for r in packing.source_weights(catalogue.shards(spark, SF)).orderBy("source_id").collect()}
    lengths, names = {}, {}
    for r in orders.in_shards(catalogue.lengths(spark, SF)).orderBy("source_id", "shard", "place").collect():
        shards = lengths.setdefault(r.source_id, [])
        shards += [[] for _ in range(r.shard + 1 - len(shards))]
        shards[r.shard].append(r.n_tokens)
        names[r.source_id, r.shard, r.place] = r.doc_seq
    walked = cursor(shares, SEED, CHUNK, len(plan), lengths)
    assert [s for s, _ in walked] == [r.source_id for r in plan]
    want = [(n, s, e, k, d, names[s, k, d], o, c, t) for n, (s, got) in enumerate(walked) for e, k, d, o, c, t in got]
    assert sorted(map(tuple, catalogue.QUERIES["shard_order_pieces"](spark, SF).collect())) == sorted(want)


def test_query_of_the_stream_equals_a_cursor(spark, monkeypatch, tmp_path):
    kept = []
    monkeypatch.setattr(catalogue, "shared_folder", lambda spark: kept.append(str(tmp_path / str(len(kept)))) or kept[-1])
    got = {r.chunk_id: r for r in catalogue.QUERIES["resumable_stream"](spark, SF).collect()}
    sources = sources_of(kept[0])
    lengths, tokens = {}, {}
    for s in sources:
        for k, (path, index, _, _) in enumerate(s.shards):
            offsets = np.fromfile(f"{kept[0]}/{index}", "<u8").astype(int)
            lengths.setdefault(s.source_id, []).append(np.diff(offsets).tolist())
            tokens[s.source_id, k] = (offsets, np.fromfile(f"{kept[0]}/{path}", "<u2"))
    n = -(-sum(s.tokens for s in sources) // CHUNK)
    assert sorted(got) == list(range(n))
    for i, (s, parts) in enumerate(cursor({s.source_id: s.weight for s in sources}, SEED, CHUNK, n, lengths)):
        flat = [t for _, k, d, o, _, m in parts for t in tokens[s, k][1][tokens[s, k][0][d] + o :][:m].tolist()]
        assert (got[i].source_id, got[i].shard, got[i].document, got[i].offset) == (s, *parts[0][1:4])
        assert got[i].sha256 == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest() and len(flat) == CHUNK
