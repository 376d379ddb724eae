import gzip

import pytest
from pyspark.sql import functions as F

from millrace.functions import options
from millrace.operators import contamination, contracts, matching
from millrace.sources import benchmarks, indexes


def texts(df):
    return sorted((r.benchmark, r.text) for r in df.collect())


def test_lines_end_where_python_ends_them(spark):
    values = ["", "a", "a\n", "\n", "a\r\nb", "a\r\rb\x0b\x0cc", "x\x1cy\x1dz\x1e", "p\x85q r ", "n\x1fm", "\n\n"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", benchmarks.split_lines(F.col("v")).alias("l")).collect()
    assert {r.v: r.l for r in got} == {v: v.splitlines() for v in values}


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"question": "q\\u2028", "choice0": "a"}\n\n   \n{"question": "r"}\x0b{"question": "s"}\r\n', encoding="utf-8")
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"question": "t"}')
    got = benchmarks.json_records(spark, str(tmp_path), "question string, choice0 string")
    assert sorted((r.question, r.choice0 or "") for r in got.collect()) == [("q ", "a"), ("r", ""), ("s", ""), ("t", "")]
    (tmp_path / "c.json").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        benchmarks.json_records(spark, str(tmp_path), "question string").collect()


def test_choices_must_be_there(spark):
    df = spark.createDataFrame([("q", "a", "b", "c", "d", None)], "question string, choice0 string, choice1 string, choice2 string, choice3 string, choice4 string")
    with pytest.raises(Exception, match="lacks choice4"):
        benchmarks.jcommonsenseqa(df).collect()
    assert texts(benchmarks.jcommonsenseqa(df.fillna("e"))) == [("jcommonsenseqa", "q a b c d e")]


def test_reading_questions(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"paragraphs": [{"context": " c ", "qas": [{"question": " q", "answers": [{"text": "x"}, {"text": "y"}]}, {"question": "r"}]}, {"context": "d", "qas": []}]}]}')
    got = benchmarks.jsquad(benchmarks.json_records(spark, str(tmp_path / "a.json"), benchmarks.ARTICLES))
    assert texts(got) == [("jsquad_context", " c "), ("jsquad_context", "d"), ("jsquad_qa", "q x y"), ("jsquad_qa", "r")]


def test_question_xml(spark, tmp_path):
    (tmp_path / "dev.xml").write_text(
        '<?xml version="1.0" encoding="UTF-8"?>\n<questions>\n<question id="1"><meta/><text> q &amp; r </text><text>second</text><answers><answer> a </answer><answer/><answer> </answer><answer>b</answer></answers></question>\n'
        "<question><answer>only</answer></question><question>\n<text><b>inner</b> tail</text></question></questions>\n"
    )
    assert texts(benchmarks.niilc(benchmarks.questions(spark, str(tmp_path)))) == [("niilc", "q & r a b")]
    bad = spark.createDataFrame([("<question><text>a</question>",)], "xml string")
    with pytest.raises(Exception):
        benchmarks.niilc(bad).collect()


def test_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([("q", None, "x", 1)], "question string, A string, B string, C int")
    assert texts(benchmarks.jmmlu(df)) == [("jmmlu", "q None x 1 ")]
    pair = spark.createDataFrame([("p", None)], "prompt string, canonical_solution string")
    assert texts(benchmarks.humaneval(pair)) == [("humaneval", "p\nNone")]
    with pytest.raises(ValueError, match="no loader"):
        benchmarks.canonical({"other": df})
    with pytest.raises(ValueError, match="no benchmark"):
        benchmarks.canonical({})


def recs(spark):
    rows = [(1, "jnli", " ".join(f"w{i}" for i in range(30))), (2, "jnli", "short record"), (3, "jmmlu", "日本語の文字を並べて二十字より長くした記録の一つです")]
    return contamination.records(spark.createDataFrame(rows, "item_id long, benchmark string, text string"))


def test_stored_indexes_give_the_same_verdicts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(25))), (2, "Short record"), (3, "日本語の文字を並べて二十字より長くした記録の一つです。"), (4, "clean"), (5, None)], "doc_id long, text string")
    indexes.save_grams(recs(spark), f"{tmp_path}/g")
    grams, keys, meta = indexes.load_grams(spark, f"{tmp_path}/g")
    assert {r.benchmark: r.examples for r in meta.collect()} == {"jnli": 2, "jmmlu": 1}
    want = contamination.check_documents(docs, recs(spark), None)
    got = contamination.check_against(docs, grams, keys, None)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    indexes.save_records(recs(spark), f"{tmp_path}/r")
    loaded = indexes.load_records(spark, f"{tmp_path}/r")
    rules = matching.rules(spark)
    assert sorted(map(repr, matching.analyse(docs, loaded, rules).collect())) == sorted(map(repr, matching.analyse(docs, recs(spark), rules).collect()))


def test_unfinished_or_foreign_indexes_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no finished index"):
        indexes.load_grams(spark, f"{tmp_path}/none")
    indexes.save_records(recs(spark), f"{tmp_path}/r")
    with pytest.raises(Exception, match="(?i)exists"):
        indexes.save_records(recs(spark), f"{tmp_path}/r")
    recs(spark).select("record_id", "benchmark", "text", "nfkc", "cjk", "key").write.mode("append").parquet(f"{tmp_path}/r/records")
    with pytest.raises(ValueError, match="6 records where 3"):
        indexes.load_records(spark, f"{tmp_path}/r")
    spark.range(1).select(F.lit(99).alias("layout")).write.parquet(f"{tmp_path}/l/meta")
    with pytest.raises(ValueError, match="layout"):
        indexes.load_records(spark, f"{tmp_path}/l")


def value(words, option, default=None):
    for i, w in enumerate(words):
        if w == option:
            return words[i + 1]
        if w.startswith(option + "="):
            return w[len(option) + 1 :]
    return default


def test_options(spark):
    lists = [[], ["--a", "1"], ["--a=1=2", "--a", "3"], ["--a", "--a", "x"], ["--ab", "1"], ["--a="], ["x", "--a", "--b", "y"]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = df.select("i", options.option_value(F.col("w"), "--a", "d").alias("v"), options.replace_option(F.col("w"), "--a", "9").alias("r")).collect()
    assert {r.i: r.v for r in got} == {i: value(w, "--a", "d") for i, w in enumerate(lists)}
    assert [r.r for r in sorted(got)] == [["--a", "9"], ["--a", "9"], ["--a", "9", "--a", "9"], ["--a", "9", "x"], ["--ab", "1", "--a", "9"], ["--a", "9"], ["x", "--a", "9", "y"]]
    with pytest.raises(Exception, match="no value"):
        df.select(options.option_value(F.array(F.lit("--a")), "--a")).collect()


def test_stops_keep_committed_steps_only(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1, 1.0, 5), ("a", 2, 1.0, 6), ("a", 3, nan, 7), ("a", 4, 1.0, 8), ("b", 1, 2.0, 5), ("c", 1, -inf, 5), ("d", 123456789, 1.0, 1), ("d", 123456790, None, 1)]
    got = contracts.controlled_stops(spark.createDataFrame(rows, "run string, step long, loss double, tokens long"), "run", "step", "loss", "tokens", 1)
    assert sorted((r.run, r.step, r.tokens_done, r.resumable_checkpoint, r.recent_successful_steps) for r in got.collect()) == [
        ("a", 2, 11, "step_00000002_diagnostic", [2]), ("c", 0, 0, "step_00000000_diagnostic", []), ("d", 123456789, 1, "step_123456789_diagnostic", [123456789]),
    ]
