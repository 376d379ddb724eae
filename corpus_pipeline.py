"""A corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, jaccard_join, quality_rules, secrets
from millrace.llm.common import Room, shielded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject.

    Null, empty and blank texts go; of repeated rows all stay or all go; an empty table stays empty; texts of any length are
    judged whole; columns may have any names (those of __millrace_<number> aside), as in all stages.
    """
    inner, names, back = shielded(docs, "doc_id", "text")
    judged, _ = quality_rules.quality(inner, spark.read.parquet(f"{sf_dir}/labels.parquet"), names)
    return back(judged.where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id (null ids last). Null, empty and blank texts all stay,
    of repeated rows one; an empty table stays empty."""
    return jaccard_join.deduplicated(docs, jaccard_join.NEAR).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts stay; of repeated rows all stay or all go; an empty table stays
    empty, and with an empty benchmark everything stays."""
    inner, names, back = shielded(docs, "text")
    return back(decontamination.tiled(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names).where(F.size("matches") == 0))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets, and n_chars of those changed. Null and empty texts stay as
    they are, repeated rows are all changed alike, an empty table stays empty."""
    inner, names, back = shielded(docs, "text")
    found = secrets.findings(inner, secrets.update(inner, None), names)
    text, n_chars = (names[docs.columns.index(c)] for c in ("text", "n_chars"))
    clean = found.withColumn(text, secrets.redacted(F.col(text), F.col("spans")))
    return back(clean.withColumn(n_chars, F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col(n_chars))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document. A null or empty text has none; repeated rows each give a row, an empty table none."""
    return bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", redact), ("byte-level BPE", encode)]

#: The learned rules and token ids have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder before the next reads it."""
    room, docs = Room(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = room.stored(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        room.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
