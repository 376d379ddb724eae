import unicodedata
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import contamination as C
from millrace.operators import grams, matching

JP = "これは日本語の評価用の問題文であり、答えは東京都の千代田区にある建物です。もう少し長くします。"
EN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix boxes of jugs and count every liquor"


def words(t):
    out, w = [], ""
    for c in unicodedata.normalize("NFKC", t).lower() + " ":
        if c in "0123456789abcdefghijklmnopqrstuvwxyz":
            w += c
        elif w:
            out.append(w)
            w = ""
    return out


def chars(t):
    return "".join(unicodedata.normalize("NFKC", t).lower().split())


def both(t):
    c, w = chars(t), words(t)
    return {"cjk": [c[i : i + 20] for i in range(len(c) - 19)], "latin": [" ".join(w[i : i + 13]) for i in range(len(w) - 12)]}


def expected_spans(docs, recs, samples):
    index = {s: {g for _, t in recs for g in both(t or "")[s]} for s in ("cjk", "latin")}
    out = {}
    for d, t in docs:
        best, seen = None, samples is None
        for s, unit, least in (("cjk", 20, 30), ("latin", 13, 20)):
            g = both(t or "")[s]
            hit = [x in index[s] for x in g]
            if samples is not None and g:
                seen |= any(hit[:: max(1, len(g) // samples)][:samples])
            run = max((len(list(v)) for k, v in groupby(hit) if k), default=0)
            n = len({x for x, h in zip(g, hit, strict=True) if h})
            if n >= 2 and run + unit - 1 >= least and (best is None or run + unit - 1 > best[1]):
                best = (n, run + unit - 1, s)
        if best and seen:
            out[d] = best
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    recs = [(0, EN), (1, JP), (2, "ＦＵＬＬ　Ｗｉｄｔｈ ｶﾅ letters and so on which are twenty words or more " + EN[:60])]
    w = EN.split()
    tail = " ".join(f"z{k}" for k in range(70))
    docs = [
        (0, "intro " + EN + " outro"), (1, "前書き " + JP), (2, " ".join(w[:19])), (3, " ".join(w[:20])), (4, " ".join(w[:13])), (5, JP[:29]), (6, JP[:30]), (7, ""), (8, None),
        (9, tail + " " + " ".join(w)), (10, "FULL WIDTH カナ letters and so on which are twenty words or more " + EN[:60]), (11, EN.upper().replace(" ", "  ")), (12, "nothing at all here"),
    ]
    return docs, recs, spark.createDataFrame(docs, "doc_id long, text string"), C.records(spark.createDataFrame(recs, "item_id long, text string"), "niilc")


@pytest.mark.parametrize("samples", [None, 48])
def test_spans_equal_brute_force(corpus, samples):
    docs, recs, df, r = corpus
    got = {x.doc_id: (x.distinct, x.span, x.script) for x in C.check_documents(df, r, samples).collect()}
    assert got == expected_spans(docs, recs, samples) and got


@pytest.mark.parametrize("size", [1 << 20, 64, 1])
def test_filtered_and_joined_grams_are_the_same(corpus, size):
    """However full the filter is: with one word nearly every gram passes it."""
    _, _, df, r = corpus
    index = C.index_grams(r)
    a, b = (sorted(map(tuple, x.collect())) for x in (grams.hits(df, index, size=size), grams.joined_hits(df, index)))
    assert a == b and a


def test_filter_lets_few_others_pass(spark, corpus):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = C.index_grams(C.records(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), "niilc"))
    passed = grams.candidates(docs, grams.filter_of(index)).count()
    assert grams.hits(docs, index).count() <= passed <= grams.hits(docs, index).count() + 0.01 * grams.exploded(docs).count()


def test_letters_that_python_and_the_jvm_lower_otherwise_are_found(spark):
    """One normaliser for both sides: what the JVM makes of a letter counts."""
    import sys

    odd = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]
    texts = ["".join(odd[k : k + 40]) for k in range(0, len(odd), 40)]
    recs = C.records(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), "niilc")
    docs = spark.createDataFrame([(i, f"vor {t} nach") for i, t in enumerate(texts)], "doc_id long, text string")
    index = C.index_grams(recs)
    assert sorted(map(tuple, grams.hits(docs, index).collect())) == sorted(map(tuple, grams.joined_hits(docs, index).collect()))


def test_fixture_spans_equal_brute_force(spark):
    docs, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    items = [tuple(x) for x in b.select("item_id", "text").collect()]
    got = {x.doc_id: (x.distinct, x.span, x.script) for x in C.check_documents(docs, C.records(b, "niilc"), None).collect()}
    assert got == expected_spans(rows, items, None) and len(got) == 3


def test_short_records_match_whole_texts_and_lines(spark):
    r = C.records(spark.createDataFrame([(0, "Tokyo Tower"), (1, "seven77"), (2, "東京都千代田区丸の内")], "item_id long, text string"), "jnli")
    docs = spark.createDataFrame([(0, "a line\n  tokyo   tower! \nmore"), (1, "tokyo tower is high"), (2, "seven77"), (3, "東京都 千代田区\n丸の内"), (4, "x\n東京都千代田区丸の内")], "doc_id long, text string")
    got = C.check_documents(docs, r).collect()
    assert {x.doc_id for x in got} == {0, 3, 4} and {x.reason for x in got} == {"exact_record"}
    s = C.index_stats(r).first()
    assert (s.examples, s.with_ngrams, s.short_exact_match, s.unmatchable) == (3, 0, 2, 1)


def test_normalisation(spark):
    texts = ["ﬁﬂ Ａ　ｂ\u001cc\u0085d e f", "İ ΑΣ ｶﾞ", "\U0001f600 é é", "", "ŉ ſ", "plain ascii"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = T.with_nfkc(df).select("i", T.chars_of(F.col("nfkc")).alias("c"), T.words_of(F.col("nfkc")).alias("w"), T.is_cjk(F.col("text")).alias("k")).collect()
    for r in rows:
        assert r.c == chars(texts[r.i]) and r.w == words(texts[r.i])
    assert len(rows) == len(texts)


def test_rules_and_best_finding(spark):
    w = EN.split()
    recs = [(0, "jnli", EN), (1, "nosuch", EN), (2, "gsm8k_answer", EN), (3, "mbpp_prompt", " ".join(w[:14])), (4, "jnli", "short but long enough"), (5, "jsquad_context", JP)]
    r = C.records(spark.createDataFrame(recs, "item_id long, benchmark string, text string"))
    docs = spark.createDataFrame([(0, EN), (1, " ".join(w[:18])), (2, "short but long enough"), (3, "so short but long enough and then ten more words to have any gram"), (4, JP + JP)], "doc_id long, text string")
    found = matching.analyse(docs, r, matching.rules(spark))
    got = {(x.doc_id, x.record_id): x for x in found.collect()}
    assert (0, 1) not in got and got[0, 0].contaminated and got[0, 2].contaminated and got[0, 0].coverage == 1.0
    assert not got[1, 0].substring and not got[1, 0].contaminated and got[1, 0].contiguous_units == 18
    assert got[1, 3].substring and got[1, 3].contaminated
    assert (2, 4) not in got and got[3, 4].contaminated and got[3, 4].matched_text is None
    assert got[4, 5].contiguous_ngrams == len(chars(JP)) - 19 and not got[4, 5].substring
    best = {x.doc_id: x.record_id for x in matching.best(found).collect()}
    assert best[0] == 0 and best[3] == 4


def test_many_short_records_equal_brute_force(spark):
    """More keys than were once allowed, most with one anchor in common, in both strings, at both ends and twice in a text."""
    keys = [(k, f"common start {k:05d}") for k in range(12_000)] + [(20_000 + k, f"{k}x{k} is a rather short key") for k in range(50)] + [(30_000, "東京都千代田区丸の内一丁目九番"), (30_001, "short"), (30_002, "w " * 11 + "q" * 300)]
    texts = ["common start 00007 common start 11999 and other words that make it a text of thirteen words at least, common start 00007", "x" * 30 + " 7x7 is a rather short key", "common start 000", "東京都千代田区丸の内一丁目九番にある建物の中で働いています", "COMMON   start\n00042 is followed by enough of other words to have a gram of words", None, "", "w " * 14 + "q" * 300, "common start 11998"]
    recs = C.records(spark.createDataFrame(keys, "item_id long, text string"), "niilc")
    short = matching.short_keys(matching.record_facts(recs).join(matching.rules(spark), "benchmark"))
    docs = T.with_nfkc(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [(r.doc_id, r.record_id) for r in matching.short_records(docs, short).collect()]
    want = set()
    for d, t in enumerate(texts):
        c, w = chars(t or ""), words(t or "")
        for k, key in keys:
            own = chars(key) if sum("\u3040" <= x <= "\u9fff" for x in key) > 0.15 * len(key) else " ".join(words(key))
            if len(own) >= 12 and (len(c) >= 20 or len(w) >= 13) and (own in c or own in " ".join(w)):
                want.add((d, k))
    assert sorted(got) == sorted(want) and len(want) == 6


def test_texts_are_handed_on_in_bounded_batches(spark):
    from millrace.functions import tables

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = " ".join(f"w{k}" for k in range(1000))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(long).alias("text")).coalesce(1)
    index = C.index_grams(C.records(spark.createDataFrame([(0, long)], "item_id long, text string"), "niilc"))
    filters = grams.filter_of(index)
    found = grams.candidates(docs.limit(100), filters)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    given = tables.arrow_map(T.with_nfkc(docs), sizes, "n long")
    assert max(r.n for r in given.collect()) < 4000  # 20 MB: Spark's own bound is 10,000 rows
    assert found.count() == 100 * (len(chars(long)) - 19 + 1000 - 12)
    made = list(tables.gathered(iter([(k, "latin", k, "g", 1) for k in range(10)]), grams.HITS, 4))
    assert [b.num_rows for b in made] == [4, 4, 2] and list(tables.gathered(iter([]), grams.HITS)) == []


def test_lines_and_texts_are_compared_in_one_pass(spark):
    odd = ["\u3000 Ｆｕｌｌ width line, of words \x85", "ΑΒΣ ΟΔΟΣ aaaa bbbb cccc\u2028", "かな混じりの一行です。ﾊﾝｶｸ", "e\u0301 \u0301x İstanbul line here", "short", "", "12345678", "a-b-c-d-e"]
    docs = [(k, "\n".join(odd[:k]) or None) for k in range(len(odd) + 1)] + [(20, " " + odd[0] + "\n"), (21, odd[2] + " words of it"), (22, "x\n" + odd[1].lower()), (23, "\r\n".join(odd[::-1]))]

    def key(t):
        share = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in t) / len(t) if t else 0
        return chars(t) if share >= 0.15 else " ".join(words(t))

    keys = {k for k in map(key, odd[::2] + ["\n".join(odd[:6])]) if len(k) >= 8}
    want = {d for d, t in docs if t and any(key(x) in keys for x in [t, *map(str.strip, t.split("\n"))])}
    found = C.exact_records(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(k,) for k in sorted(keys)], "key string"))
    assert {r.doc_id for r in found.collect()} == want and len(want) > 3 and found.schema["doc_id"].dataType.simpleString() == "int"
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # texts and lines were normalised apart


def test_the_word_span_query_makes_no_rows_of_all_grams(spark):
    from millrace.plans import catalogue

    plan = catalogue.QUERIES["contamination_word_span"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # only grams that pass the filter meet the index


def test_the_screen_reads_texts_once(spark):
    from millrace.plans import catalogue

    plan = catalogue.QUERIES["contamination_screen"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # runs, distinct grams and samples were made from the texts each for itself


def test_longest_runs_read_texts_once(spark):
    from millrace.plans import catalogue

    w = EN.split()
    recs = [(0, "jnli", EN), (1, "nosuch", EN), (2, "gsm8k_answer", " ".join(w[:14] + ["x"] + w[2:])), (4, "jnli", "short but long enough"), (5, "jsquad_context", JP)]
    r = C.records(spark.createDataFrame(recs, "item_id long, benchmark string, text string"))
    texts = [(0, EN), (1, " ".join(w[:15] + ["y"] + w[1:])), (3, "so short but long enough and then ten more words to have any gram"), (4, JP + JP), (4, "a repeated id"), (None, EN), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got, want = (sorted(map(repr, f(docs, r, matching.rules(spark)).select(*matching.RUNS).collect())) for f in (matching.runs, matching.analyse))
    assert got == want and len(want) == 7
    plan = catalogue.QUERIES["record_longest_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation [doc_id" in line]
    assert plan.count("MapInArrow") == 1 and len(reads) == 3  # both kinds of text, and ids alone; texts were joined as a whole besides


def test_memory_of_a_worker_is_a_few_times_its_longest_text(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    letters = "abcdefghij klmno pqrstu vwxyz "
    long = letters * 60_000 + EN + " " + letters * 60_000
    filters = grams.filter_of(C.index_grams(C.records(spark.createDataFrame([(0, EN)], "item_id long, text string"), "niilc")))
    monkeypatch.setattr(grams, "arrow_map", lambda df, rows, schema: rows)
    rows = grams.candidates(spark.createDataFrame([(0, "")], "doc_id long, text string"), filters)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([long])], ["doc_id", "text"])
    tracemalloc.start()
    found = [x for b in rows(iter([batch])) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = both(EN)
    assert {g for s in want for g in want[s]} <= {x["gram"] for x in found} and len(found) < 0.01 * len(long)
    assert {x["n_grams"] for x in found} == {len(chars(long)) - 19, len(words(long)) - 12}
    assert peak < 30 * len(long)  # all hashes of a text at once took over 60 bytes a character


@pytest.mark.parametrize("block", [20, 21, 64])
def test_blocks_lose_no_gram(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(grams, "BLOCK", block)
    full = np.full(4, -1, dtype=np.int64).view(np.uint64)
    own = np.zeros(1 << 10, dtype=np.uint64)
    places, bits = grams._places(grams.rolled(grams.char_ids(JP[3:23]), 20), len(own))
    own[places] = bits
    for k in (0, 19, 20, 21, 40, 41, 200):
        for items, n in ((("ab" * k)[:k], 20), ([b"w%d" % i for i in range(k)], 13)):
            assert list(grams.passing(items, n, full)) == list(range(max(0, k - n + 1)))
        assert list(grams.passing("x" * k + JP, 20, own)) == [k + 3]


def test_ascii_texts_need_no_expression(spark):
    texts = ["plain", "", None, "é", "ﬁ", "x\ny\x00", "é", "Ａ"]
    df = T.with_nfkc(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    assert {r.i: r.nfkc for r in df.collect()} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(octet_length(text") == 2 and plan.index("octet_length") < plan.index("RLIKE")  # lengths are compared first
