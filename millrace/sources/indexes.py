"""Contamination indexes kept as Parquet, so that they are made once and met by many corpora.

An index is a folder: its tables, and meta written last. A folder without meta is what a stopped writer left, and isn't read; a
folder is written once, by one writer.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import contamination, matching

#: Version of the layout; others are refused.
LAYOUT = 1


def save_grams(recs: DataFrame, path: str) -> None:
    """The index of check_documents: distinct grams of both scripts, keys of short records, and statistics by benchmark."""
    contamination.index_grams(recs).write.parquet(f"{path}/grams")
    contamination.exact_keys(recs).write.parquet(f"{path}/exact")
    contamination.index_stats(recs).withColumn("layout", F.lit(LAYOUT)).write.parquet(f"{path}/meta")


def load_grams(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, exact keys, statistics) as save_grams wrote them."""
    meta = _meta(spark, path)
    return spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/exact"), meta.drop("layout")


def save_records(recs: DataFrame, path: str) -> None:
    """The index of analyse: records with their texts. Grams follow from the texts and are made anew when they are met."""
    recs.select("record_id", "benchmark", "text", "nfkc", "cjk", "key").write.parquet(f"{path}/records")
    stored = recs.sparkSession.read.parquet(f"{path}/records")
    total = stored.agg(F.count("*").alias("records"), F.count_if(F.size(matching.own_grams()) == 0).alias("short"))
    total.withColumn("layout", F.lit(LAYOUT)).write.parquet(f"{path}/meta")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as analyse takes them; fewer or more than meta counts are an error."""
    meta, stored = _meta(spark, path).first(), spark.read.parquet(f"{path}/records")
    if meta.records != (n := stored.count()):
        raise ValueError(f"{path} holds {n} records where {meta.records} were written")
    return stored


def _meta(spark: SparkSession, path: str) -> DataFrame:
    try:
        meta = spark.read.parquet(f"{path}/meta")
    except AnalysisException as e:
        raise ValueError(f"{path} is no finished index") from e
    if [r.layout for r in meta.select("layout").distinct().limit(2).collect()] not in ([LAYOUT], []):
        raise ValueError(f"{path} has another layout than {LAYOUT}")
    return meta
