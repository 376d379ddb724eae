"""Validation windows of a folder of token shards as a Spark data source that opens no shard past its budget.

spark.dataSource.register(WindowSource); spark.read.format("token_windows") with the options path, length (tokens of a window),
budget (valid targets, over all sources), split and tasks gives (source, shard, window, tokens, valid): full windows of the shards
in the manifest's order, as a validation that reads them one after the other takes them. A target is valid unless the token before
it ends a document; reading stops before the first window at which the budget is used up. Which window that is follows from the
tokens, so the driver counts valid targets shard by shard until then, at most some budget's worth of tokens, and tasks read their
windows by seeking. Sources that a filter leaves out count towards the budget all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import shards as S

SCHEMA = "source string, shard int, window long, tokens array<int>, valid long"
#: Valid targets at which validation stops unless told otherwise.
BUDGET = 2_000_000
#: Windows that are looked at together.
AT_ONCE = 1024


def valid_targets(tokens: np.ndarray, eod: int = S.EOD) -> np.ndarray:
    """Of each row of tokens: targets that don't follow an end of document."""
    return (tokens[:, :-1] != eod).sum(axis=1)


class WindowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WindowReader(dict(self.options))


class WindowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.length = options["path"], int(options["length"])
        self.budget, self.split, self.tasks = int(options.get("budget", BUDGET)), options.get("split", "validation"), int(options.get("tasks", 8))
        if self.length < 2 or self.tasks < 1:
            raise ValueError("windows have two tokens at least, and tasks are positive")

    def windows(self, said: dict, first: int, end: int) -> Iterator[np.ndarray]:
        """Windows first to end of a shard, AT_ONCE together. The last full window is none if nothing follows it."""
        fs, folder = S._open(self.path)
        with fs.open_input_file(f"{folder}/{S.safe_path(said['path'])}") as f:
            size = f.size()
            if size % 2 or size // 2 != said.get("tokens", size // 2):
                raise ValueError(f"{said['path']} has {size // 2} tokens, the manifest {said.get('tokens')}")
            end = min(end, max(0, (size // 2 - 1) // self.length))
            f.seek(2 * first * self.length)
            while first < end:
                n = min(AT_ONCE, end - first)
                yield np.frombuffer(f.read(2 * n * self.length), "<u2").reshape(n, self.length)
                first += n

    def partitions(self) -> list[InputPartition]:
        """(shard, its declaration, first window, end) of about equal numbers of windows."""
        listed = S.declared(S.manifest_of(self.path) or {}, self.split)
        used, taken = 0, []
        for k, said in enumerate(listed):
            if used >= self.budget:
                break
            n = 0
            for rows in self.windows(said, 0, 1 << 62):
                before = used + np.cumsum(valid_targets(rows)) - valid_targets(rows)
                inside = int((before < self.budget).sum())
                n += inside
                used += int(valid_targets(rows)[:inside].sum())
                if inside < len(rows):
                    break
            taken.append((k, said, n))
        each = max(1, -(-sum(n for *_, n in taken) // self.tasks))
        return [InputPartition((k, said, first, min(first + each, n))) for k, said, n in taken for first in range(0, n, each)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        shard, said, first, end = partition.value
        source = said.get("source_id") or S.named_source(said["path"], self.split)
        for rows in self.windows(said, first, end):
            n = len(rows)
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.length + 1, self.length, dtype=np.int32)), pa.array(rows.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array([shard] * n, pa.int32()), pa.array(np.arange(first, first + n)), tokens, pa.array(valid_targets(rows).astype(np.int64))], ["source", "shard", "window", "tokens", "valid"])
            first += n


def read_windows(spark: SparkSession, path: str, length: int, budget: int = BUDGET, split: str = "validation") -> DataFrame:
    """The validation windows of a folder, within a budget of valid targets."""
    spark.dataSource.register(WindowSource)
    options = {"path": path, "length": length, "budget": budget, "split": split, "tasks": spark.sparkContext.defaultParallelism}
    return spark.read.format("token_windows").options(**options).load()
