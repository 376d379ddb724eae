"""Documents against single benchmark records: coverage, longest run, substring, and rules that decide by benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

from . import contamination, grams

#: Benchmark -> least coverage, least contiguous share, least contiguous units, whether a substring is enough.
RULES = {
    "jcommonsenseqa": (0.80, 0.80, 0, True), "jnli": (0.80, 0.80, 0, True), "niilc": (0.80, 0.80, 0, True),
    "jmmlu": (0.80, 0.80, 0, True), "jsquad_qa": (0.80, 0.80, 0, True), "jsquad_context": (0.70, 0.0, 100, False),
    "gsm8k_question": (0.80, 0.0, 20, True), "gsm8k_answer": (0.90, 0.90, 0, False),
    "humaneval_prompt": (0.80, 0.0, 20, True), "humaneval_solution": (0.80, 0.0, 20, True),
    "mbpp_prompt": (0.80, 0.0, 15, True), "mbpp_solution": (0.80, 0.0, 15, True),
}
#: Benchmarks that are replaced by their parts, and the parts' columns.
PARTS = {"gsm8k": ("question", "answer"), "humaneval": ("prompt", "solution"), "mbpp": ("prompt", "solution")}
SHOWN = 300
#: Columns of a pair that follow from the grams it shares.
RUNS = ["doc_id", "record_id", "benchmark", "record_chars", "record_ngrams", "matched", "coverage", "contiguous_ngrams", "contiguous_units", "contiguous_fraction", "matched_text"]
#: Parts of a record's anchor in the join, so that a passage that many documents share isn't one task's.
SALTS = 16


def rules(spark: SparkSession, table: dict[str, tuple[float, float, int, bool]] = RULES) -> DataFrame:
    return spark.createDataFrame([(b, *r) for b, r in table.items()], "benchmark string, min_coverage double, min_contiguous double, min_units int, allow_substring boolean")


def parts(df: DataFrame) -> DataFrame:
    """(benchmark, text) of records split into parts: df has benchmark, text, first, second; whole records keep their text."""
    whole = df.where(~F.col("benchmark").isin(*PARTS)).select("benchmark", "text")
    names = F.create_map(*(F.lit(x) for b, p in PARTS.items() for x in (b, ",".join(p))))
    split = df.where(F.col("benchmark").isin(*PARTS)).select("benchmark", F.split(names[F.col("benchmark")], ",").alias("p"), F.array("first", "second").alias("t"))
    return whole.union(split.select("benchmark", F.explode(F.arrays_zip("p", "t")).alias("x")).select(F.concat_ws("_", "benchmark", "x.p"), "x.t"))


def own_grams() -> Column:
    """Grams of a record in its one granularity: characters for CJK text, else words."""
    return F.when(F.col("cjk"), T.char_grams(F.col("nfkc"))).otherwise(T.word_grams(F.col("nfkc")))


def record_grams(recs: DataFrame) -> DataFrame:
    """(record_id, script, pos, gram) in the one granularity of each record."""
    return recs.select("record_id", F.when(F.col("cjk"), "cjk").otherwise("latin").alias("script"), F.posexplode(own_grams()).alias("pos", "gram"))


def record_facts(recs: DataFrame) -> DataFrame:
    return recs.select("record_id", "benchmark", "cjk", "key", F.char_length("key").cast("long").alias("record_chars"), F.size(own_grams()).cast("long").alias("record_ngrams"), T.chars_of(F.col("nfkc")).alias("chars"), T.words_of(F.col("nfkc")).alias("words"))


def runs(df: DataFrame, recs: DataFrame, table: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs of analyse without substring and contaminated, for which alone texts are read a second time."""
    facts = record_facts(recs).join(F.broadcast(table), "benchmark")  # table: a row per benchmark
    rows = df.select(F.col(id_).alias("doc_id"))
    found, short = _pairs(df, recs, facts, id_, text).join(rows, "doc_id").select(*RUNS), short_keys(facts)
    if short.isEmpty():
        return found
    docs = T.with_nfkc(df.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")))
    return found.unionByName(short_records(docs, short).select(*RUNS))


def _pairs(df: DataFrame, recs: DataFrame, facts: DataFrame, id_: str, text: str) -> DataFrame:
    """Pairs that share a gram, with the record's facts, what is matched of it, and its longest run."""
    rg = record_grams(recs)
    have = grams.hits(df, rg.select("script", "gram"), id_, text).select("doc_id", "gram").distinct()
    matched = have.join(rg.select("record_id", "pos", "gram"), "gram").select("doc_id", "record_id", "pos")
    pairs = contamination.longest_runs(matched, ["doc_id", "record_id"]).join(facts, "record_id")
    units = F.col("run") + F.when(F.col("cjk"), T.CHAR_GRAM).otherwise(T.WORD_GRAM) - 1
    share, part = F.col("matched") / F.col("record_ngrams"), F.col("run") / F.col("record_ngrams")
    start = (F.col("start") + 1).cast("int")
    shown = F.when(F.col("cjk"), F.substring(F.col("chars"), start, units.cast("int"))).otherwise(F.array_join(F.slice("words", start, units.cast("int")), " "))
    return pairs.withColumns({"contiguous_ngrams": F.col("run"), "contiguous_units": units, "coverage": share, "contiguous_fraction": part, "matched_text": F.left(shown, F.lit(SHOWN))})


def analyse(df: DataFrame, recs: DataFrame, table: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Every pair of a document and a record that shares a gram and whose benchmark has a rule, and whether the rule decides.

    doc_id, record_id, benchmark, record_chars, record_ngrams, matched, coverage, contiguous_ngrams, contiguous_units,
    contiguous_fraction, substring, matched_text, contaminated. A record's grams are looked up in the unordered set of the
    document's grams of both scripts; substrings count only between pairs that share a gram. Records without grams match
    documents that have some, as substrings alone, with matched_text null.
    """
    facts = record_facts(recs).join(F.broadcast(table), "benchmark")  # table: a row per benchmark
    pairs = _pairs(df, recs, facts, id_, text)
    docs = T.with_nfkc(df.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")))
    near = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.chars_of(F.col("nfkc")).alias("doc_chars"), F.array_join(T.words_of(F.col("nfkc")), " ").alias("doc_words"))
    inside = F.col("doc_chars").contains(F.col("key")) | F.col("doc_words").contains(F.col("key"))
    sub = F.col("allow_substring") & (F.col("record_chars") >= T.MIN_SUBSTRING_KEY) & inside
    decided = F.col("substring") | ((F.col("coverage") >= F.col("min_coverage")) & ((F.col("min_contiguous") == 0) | (F.col("contiguous_fraction") >= F.col("min_contiguous")))) | ((F.col("min_units") > 0) & (F.col("contiguous_units") >= F.col("min_units")))
    full = pairs.join(near, "doc_id").withColumn("substring", sub).withColumn("contaminated", decided)
    found, short = full.select(*RUNS[:-1], "substring", "matched_text", "contaminated"), short_keys(facts)
    return found if short.isEmpty() else found.unionByName(short_records(docs, short))


def short_keys(facts: DataFrame) -> DataFrame:
    """Records without grams that count as substrings."""
    return facts.where("record_ngrams = 0 and allow_substring").where(F.col("record_chars") >= T.MIN_SUBSTRING_KEY).select("record_id", "benchmark", "key", "record_chars")


def anchored(key: DataFrame) -> DataFrame:
    """key plus anchor, MIN_SUBSTRING_KEY characters of it that fewest keys have, and before, how many characters stand before it."""
    n = T.MIN_SUBSTRING_KEY
    windows = F.transform(F.sequence(F.lit(0), F.char_length("key") - n), lambda i: F.struct(F.col("key").substr(i + 1, F.lit(n)).alias("anchor"), i.alias("before")))
    each = key.select("record_id", F.explode(windows).alias("w")).select("record_id", "w.anchor", "w.before")
    counted = each.join(each.groupBy("anchor").agg(F.count("*").alias("keys")), "anchor")
    return key.join(counted.groupBy("record_id").agg(F.min(F.struct("keys", "before", "anchor")).alias("w")).select("record_id", "w.anchor", "w.before"), "record_id")


def short_records(docs: DataFrame, key: DataFrame) -> DataFrame:
    """Records without grams inside documents with grams, from their short_keys, however many there are.

    A key's rarest MIN_SUBSTRING_KEY characters are its anchor. One pass finds the anchors in the documents, by a filter of fixed
    size, with the text around them; an equi-join on the anchor brings the keys that are then compared in full.
    """
    own = anchored(key)
    reach = own.agg(F.max("record_chars")).first()[0] or 0
    text = docs.select("doc_id", F.lower("nfkc").alias("normal"))
    near = grams.around(text, own, T.MIN_SUBSTRING_KEY, reach).withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)))
    met = near.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["anchor", "salt"])
    first = F.col("at") - F.col("before")
    same = (first >= 0) & (F.col("around").substr((first + 1).cast("int"), F.col("record_chars").cast("int")) == F.col("key"))
    found = met.where(same).select("doc_id", "record_id", "benchmark", "record_chars").distinct()
    zero, one, yes = F.lit(0).cast("long"), F.lit(1.0), F.lit(True)
    return found.select("doc_id", "record_id", "benchmark", "record_chars", zero.alias("record_ngrams"), zero.alias("matched"), one.alias("coverage"), zero.alias("contiguous_ngrams"), zero.alias("contiguous_units"), one.alias("contiguous_fraction"), yes.alias("substring"), F.lit(None).cast("string").alias("matched_text"), yes.alias("contaminated"))


def best(findings: DataFrame) -> DataFrame:
    """The finding of each contaminated document with the largest coverage (to four places), then units, then least record id."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.bround("coverage", 4)), F.desc("contiguous_units"), "record_id")
    return findings.where("contaminated").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
