import zlib

import numpy as np

from millrace.llm import language, quality_rules, toxicity
from millrace.llm.common import held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_is_the_contract_fifth(spark):
    rows = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = language.language(docs, ["doc_id", "lang"]).where(held_out())
    right = named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the of and", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "", None), (5, "12 !?", "de"), (None, "the and", "en"), (6, "the of the", "en"), (7, "und der", "de")], "doc_id long, text string, lang string")
    rows = language.identify(df, language.fit(["the of and", "der die das"] * 10, ["en", "de"] * 10), ["doc_id"]).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 8
    assert {r.lang_pred for r in language.identify(df, None, ["doc_id"]).collect()} == {"und"}
    assert language.language(df.limit(0), ["doc_id"]).collect() == []


def test_a_rare_language_is_learned(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 200 == 1, "und der die").otherwise("the of and").alias("text"), F.when(F.col("id") % 200 == 1, "de").otherwise("en").alias("lang"))
    rare = df.where("lang = 'de'").where(~held_out()).count()
    for sample in (1, 12, 40):
        texts, langs = language.training_rows(df, sample=sample)
        assert len(langs) == max(sample, 2) and langs.count("de") == min(rare, len(langs) // 2)
        assert all((t == "und der die") == (x == "de") for t, x in zip(texts, langs, strict=True))


def test_toxicity_finds_planted_words_and_misspellings(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{k}ord" for k in range(200)]
    bad = ["stupidhead", "moronic", "worthlessly"]
    texts, toxic = [], []
    for i in range(240):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            words[int(rng.integers(60))] = str(rng.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    model = toxicity.fit(texts, toxic, toxicity.Settings(epochs=30))
    df = spark.createDataFrame([(0, "w1ord w2ord w3ord " * 30 + "stupidhed"), (1, "w5ord w9ord " * 40), (2, None), (3, ""), (4, "moronic")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert got[4].predicted == 1 and got[0].score > got[1].score + 0.1  # the misspelling shares n-grams
    assert got[1].predicted == 0 and got[2].predicted == 0 and got[3].score == got[2].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.fit(["a"], [1]) is None


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels, ["doc_id"]).where(held_out()).join(labels, "doc_id")
    shares = {r.toxic: r.flagged for r in scored.groupBy("toxic").agg(F.avg("predicted").alias("flagged")).collect()}
    assert shares[1] >= 0.75 and shares[0] <= 0.03, shares


def brute_statistics(text):
    words, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            words.append(word)
            word = ""
        else:
            word += c
    words = [w for w in [*words, word] if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_statistics_equal_brute_force(spark):
    texts = ["", None, "a b c", "a a a a", "x y z x y z q", "l1\nl1\n \nl1 \nl2", "é # ** <b>\xa0nbsp x", "a b c d a b c e f a b c", "\t\n", "one\x0btwo\x0cthree\rfour\x1cfive"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_statistics(df, ["doc_id"]).collect():
        assert tuple(r[c] for c in quality_rules.COUNTS) == brute_statistics(texts[r.doc_id] or ""), texts[r.doc_id]


def test_quality_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged, rules = quality_rules.quality(docs, labels, ["doc_id", "text"])
    rows = judged.join(labels, "doc_id", "left").collect()
    assert rules and len(rows) == docs.count()
    for r in rows:
        n, _, _, _, rep = brute_statistics(r.text)[:5] if len(r.text) < 1500 else (r.n_words, 0, 0, 0, r.n_repeat_words)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    fit = [r for r in rows if r.quality is not None and not r.base_failed]
    assert sum(r.kept for r in fit if r.quality == 1) >= 0.97 * sum(r.quality for r in fit)
    assert sum(r.kept for r in fit if r.quality == 0) <= 0.2 * sum(1 - r.quality for r in fit)


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "w " * 60), (2, None)], "doc_id long, text string")
    judged, rules = quality_rules.quality(df, spark.createDataFrame([], "doc_id long, quality int"), ["doc_id"])
    assert rules == [] and {r.doc_id: r.kept for r in judged.collect()} == {1: False, 2: False}


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 4] <= 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97


def test_letters_that_python_doesn_t_know_have_a_score(spark):
    fitted = language.fit(["the house and the garden"] * 20 + ["das Haus und der Garten"] * 20, ["en"] * 20 + ["de"] * 20)
    texts = ["\u0558", "\u1c8a\u1c8a", "\U000105c0", "the house", "...", None]
    got = language.identify(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), fitted, ["doc_id"]).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 and r.score == r.score and r.lang_pred in ("en", "de", "und") for r in got)
    assert [r.lang_pred for r in got][3:] == ["en", "und", "und"]
