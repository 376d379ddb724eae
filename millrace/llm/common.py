"""Shared plumbing: durable scratch tables, Arrow mapping, text conventions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest Arrow batch handed to a Python worker. Bounds worker memory when texts are long.
BATCH_BYTES = 8 << 20
#: Spark's setting that removes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor shares.

    Where a local session (tests) names none, a temporary folder is chosen and recorded in the session; on a cluster that is an
    error, as executors wouldn't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet under path and read it back with the same schema.

    The shuffle files of the write go as soon as it is done, as nothing reads them again.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, so that long texts don't pile up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(rows, schema)


class Room:
    """Scratch tables of one operator run; those that nothing reads any more are removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """df, written to a fresh folder and read again."""
        path = scratch(self.spark, label)
        out = stored(df, path)
        self.paths[id(out)] = path
        self.kept.append(out)  # so that its id isn't used again
        return out

    def drop(self, table: DataFrame) -> None:
        if path := self.paths.pop(id(table), None):
            dropped(self.spark, path)

    def clear(self, *but: DataFrame) -> None:
        """Remove all tables but those given."""
        stay = {id(t) for t in but}
        for t in self.kept:
            if id(t) not in stay:
                self.drop(t)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def kept(df: DataFrame, keep: list[str], *results: str) -> list[Column]:
    """The columns to keep; one that has the name of a result (in any case) comes out as input_<name>."""
    taken = {r.lower() for r in results}
    return [df[c].alias(f"input_{c}") if c.lower() in taken else df[c] for c in keep]


def shielded(df: DataFrame, *own: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df for an operator that reads the columns own, whatever its other columns are called: all columns of df under other names,
    beside own; these names; and a function that gives a result back under df's names."""
    names = [f"__millrace_{i}" for i in range(len(df.columns))]
    inner = df.select(*(df[c].alias(n) for n, c in zip(names, df.columns, strict=True)), *own)
    return inner, names, lambda out: out.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)))


def fields(schema: StructType) -> list[str]:
    """The columns of a schema as text, for the schema of a result."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
