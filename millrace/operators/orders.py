"""The two-level order of a source: its shards, permuted anew each epoch, and in each shard its documents, permuted too.

Permutations are NumPy's of a PCG64 generator that is seeded by seed, source, epoch and purpose. A task makes one shard's order, so
no source is sorted and none passes through one task; prefix sums over the shards in their order place every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .interleave import permutation
from .packing import offsets

#: Tokens after which the packer starts another shard.
SHARD_TOKENS = 1 << 16


def shard_order(seed: int, source: str, epoch: int, n: int) -> np.ndarray:
    """The n shards of a source in the order of an epoch."""
    return permutation(seed, source, epoch, "shards", n)


def document_order(seed: int, source: str, epoch: int, shard: int, n: int) -> np.ndarray:
    """The n documents of a shard in the order of an epoch."""
    return permutation(seed, source, epoch, f"documents:{shard}", n)


def in_shards(lengths: DataFrame, tokens: int = SHARD_TOKENS) -> DataFrame:
    """lengths (source_id, doc_seq, n_tokens) plus shard and place in it: a new shard begins with the first document that starts
    behind so many more tokens. Shards are numbered from 0; the long documents that leave a number out don't show."""
    cut = offsets(lengths).withColumn("__cut", F.expr(f"start div {tokens}"))
    numbered = cut.select("source_id", "__cut").distinct().withColumn("shard", F.row_number().over(Window.partitionBy("source_id").orderBy("__cut")) - 1)  # a row per shard
    place = F.row_number().over(Window.partitionBy("source_id", "__cut").orderBy("doc_seq")) - 1
    return cut.withColumn("place", place.cast("long")).join(numbered, ["source_id", "__cut"]).select("source_id", "shard", "place", "doc_seq", "n_tokens")


def _ordered_shards(per: DataFrame, seed: int) -> DataFrame:
    """(source_id, epoch, at, shard) from (source_id, epoch, shards): a number for each shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["shards"]
                order = shard_order(seed, r["source_id"], r["epoch"], n)
                yield pa.RecordBatch.from_arrays([pa.array([r["source_id"]] * n, pa.string()), pa.array([r["epoch"]] * n, pa.int32()), pa.array(np.arange(n)), pa.array(order.astype(np.int32))], ["source_id", "epoch", "at", "shard"])

    return per.mapInArrow(rows, "source_id string, epoch int, at long, shard int")


def _ordered_documents(shards: DataFrame, seed: int) -> DataFrame:
    """A row per document and epoch from (source_id, epoch, shard, base, documents): its place in the stream."""
    names = ["source_id", "epoch", "shard", "place", "doc_seq", "start", "end"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                source, epoch, shard, base = (batch.column(c)[k].as_py() for c in ("source_id", "epoch", "shard", "base"))
                docs = batch.column("documents")[k].values
                n = len(docs)
                order = document_order(seed, source, epoch, shard, n)
                docs = docs.take(pa.array(order))
                end = base + np.cumsum(docs.field("n_tokens").to_numpy())
                columns = [pa.array([source] * n, pa.string()), pa.array([epoch] * n, pa.int32()), pa.array([shard] * n, pa.int32()), docs.field("place"), docs.field("doc_seq"), pa.array(end - docs.field("n_tokens").to_numpy()), pa.array(end)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return shards.mapInArrow(rows, "source_id string, epoch int, shard int, place long, doc_seq long, start long, end long")


def streams(lengths: DataFrame, plan: DataFrame, chunk: int, seed: int) -> DataFrame:
    """(source_id, epoch, shard, place, doc_seq, start, end): documents in as many epochs as the plan needs, in the two-level order.

    lengths (source_id, shard, place, doc_seq, n_tokens) with places from 0 in each shard; what interleave.pieces takes.
    """
    document = F.struct(F.col("place").cast("long").alias("place"), F.col("doc_seq").cast("long").alias("doc_seq"), F.col("n_tokens").cast("long").alias("n_tokens"))
    shards = lengths.groupBy("source_id", "shard").agg(F.sum("n_tokens").alias("tokens"), F.array_sort(F.collect_list(document)).alias("documents"))  # a shard's size is the packer's choice
    per = lengths.groupBy("source_id").agg(F.sum("n_tokens").alias("tokens"), (F.max("shard") + 1).cast("int").alias("shards")).where("tokens > 0")
    needed = plan.groupBy("source_id").agg((F.max("rank") + 1).alias("n")).join(per, "source_id")
    epochs = needed.select("source_id", "tokens", "shards", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") * chunk - 1) / F.col("tokens")).cast("int"))).alias("epoch"))
    placed = _ordered_shards(epochs.select("source_id", "epoch", "shards"), seed).join(shards.select("source_id", "shard", "tokens"), ["source_id", "shard"])
    ahead = Window.partitionBy("source_id", "epoch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    based = placed.withColumn("base", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).select("source_id", "epoch", "shard", "base")
    based = based.join(epochs.select("source_id", "epoch", "tokens"), ["source_id", "epoch"]).select("source_id", "epoch", "shard", (F.col("base") + F.col("epoch") * F.col("tokens")).alias("base"))
    return _ordered_documents(based.join(shards.select("source_id", "shard", "documents"), ["source_id", "shard"]).select("source_id", "epoch", "shard", "base", "documents"), seed)
