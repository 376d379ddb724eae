"""Benchmark index and document checks: exact records, sampled screen, longest spans of shared n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

from . import grams

#: Samples of the screen. It can miss a document whose only hits lie between or after them; None looks at every gram.
SCREEN = 48


def records(df: DataFrame, benchmark: str | None = None, id_: str = "item_id", text: str = "text") -> DataFrame:
    """(record_id, benchmark, text, nfkc, cjk, key) of a benchmark table without, or with, a benchmark column."""
    named = df.select(F.col(id_).alias("record_id"), (F.col("benchmark") if benchmark is None else F.lit(benchmark)).alias("benchmark"), F.col(text).alias("text"))
    return T.with_nfkc(named).withColumns({"cjk": T.is_cjk(F.col("text")), "key": T.key_of(F.col("text"), F.col("nfkc"))})


def index_grams(recs: DataFrame) -> DataFrame:
    """Distinct (script, gram) of both granularities of every record."""
    return grams.exploded(recs, "record_id").select("script", "gram").distinct()


def exact_keys(recs: DataFrame) -> DataFrame:
    """Distinct keys of records without any gram that are long enough to compare as a whole."""
    none = (F.size(T.char_grams(F.col("nfkc"))) == 0) & (F.size(T.word_grams(F.col("nfkc"))) == 0)
    return recs.where(none & (F.char_length("key") >= T.MIN_SHORT_KEY)).select("key").distinct()


def index_stats(recs: DataFrame) -> DataFrame:
    """Per benchmark: examples, how they can be matched, the share that can, and grams with repeats."""
    n = F.size(T.char_grams(F.col("nfkc"))) + F.size(T.word_grams(F.col("nfkc")))
    per = recs.select("benchmark", n.cast("long").alias("n"), F.char_length("key").alias("k"), "cjk")
    short = (F.col("n") == 0) & (F.col("k") >= T.MIN_SHORT_KEY)
    return per.groupBy("benchmark").agg(
        F.count("*").alias("examples"), F.count_if(F.col("n") > 0).alias("with_ngrams"), F.count_if(short).alias("short_exact_match"),
        F.count_if((F.col("n") == 0) & ~short).alias("unmatchable"), (F.count_if((F.col("n") > 0) | short) / F.greatest(F.count("*"), F.lit(1))).alias("coverage"),
        F.sum("n").alias("ngrams"), F.bool_or("cjk").alias("has_cjk"),
    )


def longest_runs(hits: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, matched, run, start): all positions, and the longest run of consecutive ones, the first of equals. Positions must be distinct."""
    w = Window.partitionBy(*keys).orderBy(pos)
    islands = hits.withColumn("__island", F.col(pos) - F.row_number().over(w)).groupBy(*keys, "__island").agg(F.count("*").alias("run"), F.min(pos).alias("start"))
    best = islands.groupBy(*keys).agg(F.sum("run").alias("matched"), F.max(F.struct("run", (-F.col("start")).alias("back"))).alias("x"))
    return best.select(*keys, "matched", F.col("x.run").alias("run"), (-F.col("x.back")).alias("start"))


def sampled(samples: int | None = SCREEN) -> Column:
    """Whether a hit is one of its text's sampled grams; without samples any is."""
    if samples is None:
        return F.lit(True)
    step = F.greatest(F.lit(1), F.floor(F.col("n_grams") / samples))
    return (F.pmod(F.col("pos"), step) == 0) & (F.floor(F.col("pos") / step) < samples)


def spans(hits: DataFrame, samples: int | None = SCREEN) -> DataFrame:
    """Verdicts of documents with a long enough span: doc_id, reason, distinct, span, script, span_cjk, span_latin.

    The larger span wins although one counts characters and the other words; equal ones go to cjk. Both are given besides.
    """
    unit = F.when(F.col("script") == "cjk", T.CHAR_GRAM).otherwise(T.WORD_GRAM)
    least = F.when(F.col("script") == "cjk", T.MIN_SPAN_CHARS).otherwise(T.MIN_SPAN_WORDS)
    w = Window.partitionBy("doc_id", "script").orderBy("pos")
    starts = F.when(F.coalesce(F.col("pos") - F.lag("pos").over(w) > 1, F.lit(True)), F.col("pos"))
    islands = hits.withColumn("__starts", starts).withColumn("__run", F.col("pos") - F.max("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    # hits are made from whole texts: they are read once
    per = islands.groupBy("doc_id", "script").agg(F.max("__run").alias("run"), F.countDistinct("gram").alias("distinct"), F.bool_or(sampled(samples)).alias("sampled")).withColumn("span", F.col("run") + unit - 1)
    long = (F.col("distinct") >= T.MIN_DISTINCT) & (F.col("span") >= least)
    best = per.groupBy("doc_id").agg(
        F.max_by(F.when(long, F.struct("distinct", "span", "script")), F.when(long, F.struct("span", F.col("script") == "cjk"))).alias("b"),
        F.max(F.when(long & (F.col("script") == "cjk"), F.col("span"))).alias("span_cjk"), F.max(F.when(long & (F.col("script") == "latin"), F.col("span"))).alias("span_latin"), F.bool_or("sampled").alias("sampled"),
    )
    return best.where("sampled and b is not null").select("doc_id", F.lit("ngram_span").alias("reason"), "b.distinct", "b.span", "b.script", "span_cjk", "span_latin")


def exact_records(df: DataFrame, keys: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of documents that are, or have a line that is, one of the keys."""
    return grams.keyed(df, keys, id_, text).join(keys, "key", "left_semi").select("doc_id").distinct()


def check_documents(df: DataFrame, recs: DataFrame, samples: int | None = SCREEN, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Contaminated documents and why: an exact record first, else the longest span. Clean documents have no row."""
    return check_against(df, index_grams(recs), exact_keys(recs), samples, id_, text)


def check_against(df: DataFrame, index: DataFrame, keys: DataFrame, samples: int | None = SCREEN, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """check_documents with an index that is at hand: its grams and exact keys."""
    found = spans(grams.hits(df, index, id_, text), samples)
    if keys.isEmpty():
        return found
    exact = exact_records(df, keys, id_, text)
    whole = df.select(F.col(id_).alias("doc_id"), F.char_length(text).cast("long").alias("span")).join(exact, "doc_id", "left_semi")
    none = F.lit(None)
    rows = whole.select("doc_id", F.lit("exact_record").alias("reason"), F.lit(1).cast("long").alias("distinct"), "span", none.cast("string").alias("script"), none.cast("long").alias("span_cjk"), none.cast("long").alias("span_latin"))
    return rows.unionByName(found.join(exact, "doc_id", "left_anti"))
