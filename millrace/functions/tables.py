"""How tables are dealt out, and handed to Python."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Largest Arrow batch handed to a Python worker; Spark's own bound is 10,000 rows, of any length.
BATCH_BYTES = 8 << 20
#: Rows that a worker gathers before it hands them on.
ROWS = 1 << 14


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table of one small file would be one task."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def bounded(spark: SparkSession) -> None:
    """From here on, batches of the session are bounded in bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes."""
    bounded(df.sparkSession)
    return df.mapInArrow(rows, schema)


def gathered(rows: Iterator[tuple], schema: pa.Schema, at_once: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, however many there are."""
    for first in rows:
        some = [first, *itertools.islice(rows, at_once - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], f.type) for k, f in enumerate(schema)], schema=schema)
