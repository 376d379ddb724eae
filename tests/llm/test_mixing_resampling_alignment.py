"""The draw, the mix and the alignment against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, mixing, queries, resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, rank string, `a.b` int, n int, start int"
ODD = [None, "", "   ", "one", "One two, one TWO! 3x\tthree", "ß é ñandú 東京 タワー", "x" * 70 + " " + "y" * 300 + " z", "a\n\n b  c 　 d e", "word " * 30, "word " * 30]


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i if i != 3 else None, t, sources[i] if sources else "s", "r", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


# Importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), words + [f"{a} {b}" for a, b in itertools.pairwise(words)]


def plain_draw(rows, targets, buckets=10_000, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in plain_features(x)[1]), Counter(bucket(f) for x in targets for f in plain_features(x)[1])
    ns, nt = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out, eligible = [], []
    for d, x in rows:
        words, features = plain_features(x)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= least:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return out


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("parameters", [{}, {"size": 7, "run": 10}, {"size": 3, "run": 5, "percent": 100}, {"percent": 0}, {"size": 10, "percent": 60, "least": 1}])
def test_draw_equals_brute_force(spark, parameters):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).repartition(5)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = plain_draw([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in benchmark.collect()], **{k: v for k, v in parameters.items() if k in ("percent", "least")})
    got = resampling.resample(docs, benchmark, **parameters)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(got.collect()) == ordered(plain)


def test_draw_of_odd_rows(spark):
    texts, target = [*ODD, *(" ".join(f"w{(i * j) % 50}" for j in range(30)) for i in range(40))], ["w1 w2 w3", None]
    got = resampling.resample(frame(spark, texts), spark.createDataFrame([(t,) for t in target], "text string"), size=4, run=3, percent=50)
    assert ordered(got.collect()) == ordered(plain_draw([(i if i != 3 else None, t) for i, t in enumerate(texts)], target, percent=50))
    assert resampling.resample(frame(spark, texts).limit(0), frame(spark, ODD)).count() == 0


def test_scores_that_many_documents_share_are_cut_by_id(spark):
    """One id's noise for all would need equal ids; equal scores come from a table of scores instead."""
    eligible = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2 * 5).alias("score"))
    cuts = resampling.cuts_of(eligible, 700, [(5, 500), (0, 500)], 100)
    assert [s for s, _ in cuts] == [5] * 4 + [0] * 5 and cuts[4] == (0, None) and all(a < b for a, b in itertools.pairwise(d for s, d in cuts if s == 5))


def test_repeated_rows_are_all_ranked(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = resampling.resample(spark.createDataFrame([(1, text)] * 50 + [(2, text)] * 30, "doc_id long, text string").repartition(4), spark.createDataFrame([], "text string"), size=10, run=7)
    ranks = sorted(r.rank for r in got.collect() if r.rank is not None)
    assert ranks == list(range(1, 21)) and got.count() == 80


def test_very_long_texts_are_taken_in_slices(spark):
    text = " ".join(f"Wort{i % 977}" for i in range(300_000)) + " " + "q" * 100_000
    _, features = plain_features(text)
    f = resampling.Features()
    found = np.concatenate([b for _, b in f.of(text)])
    assert Counter(found.tolist()) == Counter(zlib.crc32(x.encode()) % 10_000 for x in features)


def test_tournament_sorts():
    r = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(9), r.randrange(3)) for _ in range(r.randrange(6))) for _ in range(k)]
        tree, out = resampling.Tournament(runs), []
        while (x := tree.pop()) is not None:
            out.append((runs[x[0]][x[1]], x[0]))
        assert out == sorted((v, i) for i, run in enumerate(runs) for v in run)


# Mixing


def plain_targets(sizes):
    """Shares by weight, capped round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(3 * sizes[s]) for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over


def checked_mix(rows, mix):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    wanted = plain_targets(dict(sizes))
    out = mix.taken().collect()
    assert sorted(map(repr, ((r.doc_id, r.source, r.size) for r in out))) == sorted(repr((d, s, size(t))) for d, s, t in rows)
    got = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source], rel=1e-9) and 0 <= r.taken <= 3 * r.size
        got[r.source] += r.taken
    for s, w in wanted.items():
        assert abs(got[s] - w) <= 1
    return out


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for parameters in ({"block": 64, "per_shard": 50}, {}):
        mix = mixing.Mix(docs, **parameters)
        first = checked_mix(rows, mix)
        assert ordered(mixing.Mix(docs.repartition(7), **parameters).taken().collect()) == ordered(first)


def test_shards_take_disjoint_blocks_up_to_their_quotas(spark):
    mix = mixing.Mix(spark.read.parquet(f"{SF}/documents.parquet"), block=32, per_shard=40)
    blocks, quotas = mix.blocks().collect(), mixing.quotas_of_shards(mix.sources.select("n", "quota"), mix.total, 40).collect()
    sources = {r.n: r for r in mix.sources.collect()}
    assert len({(b.n, b.epoch, b.block) for b in blocks}) == len(blocks) == mix.total
    assert Counter((b.shard, b.n) for b in blocks) == Counter({(q.shard, q.n): q.quota for q in quotas})
    per = Counter(b.shard for b in blocks)
    assert max(per.values()) - min(per.values()) <= len(bin(len(per))) and len(per) > 8
    assert all(sorted(b.place for b in blocks if b.shard == s) == list(range(n)) for s, n in per.items())
    for n, s in sources.items():
        own = [b for b in blocks if b.n == n]
        assert len(own) == s.quota and sum(b.words for b in own) == s.goal
        epochs = Counter(b.epoch for b in own)
        assert all(epochs[e] == s.blocks for e in range(max(epochs, default=0)))


def test_pieces_hold_each_block_whole(spark):
    mix = mixing.Mix(spark.read.parquet(f"{SF}/documents.parquet"), block=32, per_shard=40)
    words = Counter()
    for p in mix.pieces().collect():
        assert 0 <= p.first and p.first + p.words <= p.size
        words[p.shard, p.place] += p.words
    assert words == Counter({(b.shard, b.place): b.words for b in mix.blocks().collect()})


def test_hypergeometric_draws(spark):
    """Counts of draws at evenly spread quantiles follow the distribution."""
    for n, k, d in ((10, 4, 5), (50, 50, 20), (7, 0, 3), (400, 90, 200), (1, 1, 0)):
        rows = 2000
        u = (F.col("id") + 0.5) / rows
        x = spark.range(rows).select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), u).alias("x"))
        got, expected = Counter(r.x for r in x.collect()), {x: math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) for x in range(max(0, d + k - n), min(d, k) + 1)}
        assert set(got) <= set(expected) and all(abs(got[x] / rows - p) <= 1.5 / rows for x, p in expected.items())


def test_mix_of_odd_rows(spark):
    sources = ["b", None, "a", "a", "ä", None, "c", "c", "b", "b"]
    docs = frame(spark, ODD, sources)
    checked_mix([(i if i != 3 else None, sources[i], t) for i, t in enumerate(ODD)], mixing.Mix(docs, block=4, per_shard=3))
    assert mixing.Mix(docs.limit(0)).taken().count() == 0
    assert all(r.taken == 0 for r in mixing.Mix(docs.where("text is null or text = ''")).taken().collect())
    twice = docs.union(docs)
    checked_mix([(i if i != 3 else None, sources[i], t) for i, t in enumerate(ODD)] * 2, mixing.Mix(twice, block=4, per_shard=3))


def test_mix_runs_without_python(spark):
    plan = mixing.Mix(spark.read.parquet(f"{SF}/documents.parquet")).taken()._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Alignment


class Plain:
    """The libraries on whole texts, cuts by running sums."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
        self.letters = alignment.byte_letters()

    def groups(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text)
        raw_a = [bytes(self.letters[c] for c in t) for t in a.tokens]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            return None
        ends = [list(itertools.accumulate(map(len, r))) for r in (raw_a, raw_b)]
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            out.append((a.ids[i:x], b[j:y]))
            i, j = x, y
        return out


def plain_alignment(texts):
    plain = Plain()
    found = [plain.groups(t) for t in texts]
    links = [Counter(p for a, b in g for p in itertools.product(a, b)) if g else Counter() for g in found]
    counts = Counter(p for x in links for p in x)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, x in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), x.total(), sum(m for p, m in x.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in x.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HOSTILE = ["▁x y", "a<|endoftext|>b", "<s>x</s> <0x41>", "\n \n", " lead", "tail ", "x" * 3000, " " * 3000, "é" * 700, "🎉🎊 " * 40, "a b   c", "don't can't we've\r\n\tx", "東京タワーは高い。" * 30, "\x00\x01 \x7f", "é ﬁ Ⅳ", "0123456789" * 50, "aaaa " * 300, "\t\t x", "1 000 000,00"]


@pytest.mark.parametrize("hot", [1 << 18, 3, 0])
def test_alignment_equals_the_libraries(spark, hot):
    texts = [*ODD, *HOSTILE, *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), hot=hot).collect()}
    expected = plain_alignment(texts)
    assert [i for i, e in enumerate(expected) if got[i] != e] == []


def test_alignment_of_odd_tables(spark):
    docs = frame(spark, ODD)
    assert alignment.align(docs.limit(0)).count() == 0
    twice = [tuple(r[c] for c in COLUMNS) for r in alignment.align(docs.union(docs)).collect()]
    assert sorted(twice) == sorted(plain_alignment(ODD * 2))


def test_long_units_are_aligned_in_time(spark):
    own = alignment.aligner(public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND))
    r = random.Random(3)
    text = "".join(r.choice("abcdefghij東京éß0123") for _ in range(200_000))
    figures, digest, pairs, times = own.document(text)
    assert figures[3] == times.sum() and len(digest) == 64 and (np.diff(pairs) > 0).all()


def test_queries_are_registered():
    assert {"op11_importance_resampling", "op12_source_mixing", "op13_token_alignment"} <= set(queries.QUERIES)
