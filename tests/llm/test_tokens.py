import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, token_counts, training_order

TEXTS = ["", None, "a", "  \n\t ", "don't 'reading 'll", "tabs\t\tand   runs \n\n of　space ", "é\U0001f600ß 12ab ſ", "<|endoftext|>x<|endo <|endoftext|>", "a" * 3000, "word " * 500, " " * 2500, "x\x1c\x1d y"]


def test_prefix_counts_equal_the_library_at_every_prefix():
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    c = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    for t in TEXTS:
        t = (t or "")[:80]
        changes = c.changes(t)
        assert len(changes) == len(t)
        for i in range(len(t) + 1):
            assert token_counts.count_at(changes, i) == len(library.encode(t[:i], add_special_tokens=False).ids), (t, i)


def test_budgets_need_no_encoding():
    c = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    changes = c.changes("one two three four five six seven")
    n = token_counts.longest_within(changes, 3)
    assert token_counts.count_at(changes, n) <= 3
    assert all(token_counts.count_at(changes, k) > 3 for k in range(n + 1, len(changes) + 1))


def test_token_counts_over_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "again")], "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    rows = token_counts.prefix_counts(df, ["doc_id"], budget=8).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 8)
        assert token_counts.count_at(r.changes, r.fit_chars) <= 8
    assert token_counts.prefix_counts(df.limit(0), ["doc_id"]).collect() == []


def test_encoding_equals_the_library_and_comes_back(spark):
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    big = ("some words of a long text\n\n  with spaces" * 60) + " " * 1500 + "end"
    df = spark.createDataFrame(list(enumerate([*TEXTS, big])), "doc_id long, text string")
    for r in bpe.encode(df, ["doc_id"]).collect():
        t = ([*TEXTS, big][r.doc_id]) or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        if len(t) < 2000 or t.strip():
            assert ids == c.library.encode_ordinary(t)
        assert r.decodes and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, ["doc_id"]).select("doc_id", "ids"), ["doc_id"]).collect()
    assert {r.doc_id: r.bytes for r in back} == {i: (t or "").encode() for i, t in enumerate([*TEXTS, big])}


@pytest.mark.parametrize("chunk", [1, 7, 50])
def test_safe_parts_change_nothing(monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    for t in TEXTS:
        assert "".join(bpe.safe_parts(t or "")) == (t or "")
        if t and t.strip():
            assert c.encode(t) == c.library.encode_ordinary(t)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_slots_are_a_keyed_permutation(n):
    slots = training_order.slots_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 64 or slots.tolist() != training_order.slots_of(np.arange(n), n, key=1).tolist()
    part = np.arange(n)[::3]
    assert training_order.slots_of(part, n).tolist() == slots[::3].tolist()


def test_shards_hold_every_sequence_once(spark, tmp_path):
    texts = [*TEXTS, "more and more words " * 200]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id")], "doc_id long, text string").repartition(3)
    out = f"file://{tmp_path}/shards"
    rows = training_order.training_order(df, length=16, slots_per_shard=8, out=out).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    read = list(training_order.read_slots(out, 0, 10**6, 16, 8))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read] == [r.ids_sha256 for r in rows]
    resumed = list(training_order.read_slots(out, 11, 9, 16, 8))
    assert [x.tolist() for x in resumed] == [x.tolist() for x in read[11:20]]
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    want = sorted(i for t in [*texts, "null id"] for i in [*c.encode(t or ""), training_order.END])
    assert sorted(i for x, r in zip(read, rows, strict=True) for i in x[: r.n_tokens].tolist()) == want
    assert {d for r in rows for d in r.doc_ids} == {*range(len(texts)), None}
    assert all(os.path.getsize(tmp_path / "shards" / f) % 32 == 0 for f in os.listdir(tmp_path / "shards") if f.endswith(".bin"))


def test_no_rows_no_shards(spark):
    assert training_order.training_order(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000, "a" * 1_000_000, "\u0301" * 1_000_000, ("a" + " " * 1500) * 100])
def test_runs_of_a_million_characters(text):
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    assert c.decode(c.encode(text)) == text.encode()


def test_runs_are_cut_where_the_pattern_would():
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    for k in (999, 1000, 1001, 2000):
        for end in ("b", "\nb", "", "!", " b"):
            for space in (" ", "\n", "\t "):
                t = "x" + (space * k)[:k] + end
                assert c.encode(t) == c.library.encode_ordinary(t)


def test_kept_columns_named_as_results(spark):
    df = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, n_tokens string")
    for f in (bpe.encode, token_counts.prefix_counts):
        row = f(df, ["doc_id", "n_tokens"]).collect()[0]
        assert row.input_n_tokens == "mine" and row.n_tokens == 2


def slow_slot(number, n, key):
    """The permutation of one number in plain Python: six rounds over halves, walked until the result is below n."""
    word = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & word
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & word
        return x ^ (x >> 31)

    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for k in range(1, 7):
            own = mix(((k * 0x9E3779B97F4A7C15) & word) ^ key)
            left, right = right, left ^ (mix(right ^ own) & ((1 << half) - 1))
        number = left << half | right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_slots_equal_a_slow_permutation(n):
    assert training_order.slots_of(np.arange(n), n, 99).tolist() == [slow_slot(i, n, 99) for i in range(n)]


def test_shards_are_there_when_the_call_returns(spark, tmp_path, monkeypatch):
    """Several shards to a task, each with the documents of its sequences; reading the manifest writes nothing again."""
    monkeypatch.setattr(training_order, "TASKS", 2)
    texts = [f"text number {i} " * (i % 7 + 1) for i in range(60)] * 2
    order = training_order.training_order(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), length=16, slots_per_shard=8, out=f"{tmp_path}/shards")
    names = {f: os.stat(tmp_path / "shards" / f).st_mtime_ns for f in os.listdir(tmp_path / "shards") if not f.endswith(".crc")}
    rows = order.orderBy("slot").collect()
    assert len(names) == -(-len(rows) // 8) > 4 and not any(f.endswith(".part") for f in names)
    assert names == {f: os.stat(tmp_path / "shards" / f).st_mtime_ns for f in names}
    c = bpe.coder(public_tokenizers.path(bpe.RANKS))
    read = list(training_order.read_slots(f"file://{tmp_path}/shards", 0, 10**6, 16, 8))
    whole = [(r.doc_ids, c.decode([i for i in ids.tolist()[: r.n_tokens] if i != training_order.END]).decode()) for r, ids in zip(rows, read, strict=True)]
    assert {d for docs, _ in whole for d in docs} == set(range(120))
    for docs, text in whole:
        joined = "".join(texts[d] for d in docs)
        assert text in joined and len(docs) == len(set(docs))
