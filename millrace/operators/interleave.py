"""Weighted interleaving of sources in closed form.

Chunks are always full, and which source a chunk comes from depends on the seed and weights alone. So chunk n of rank k within
its source holds the source's tokens [k C, (k + 1) C), where a source's stream is its documents, permuted anew each epoch.
Prefix sums over documents and an equi-join on the chunk's rank give every chunk directly; resuming means starting at any n.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import twister

from .packing import running

COVERAGE_STEPS = 100
#: Draws made at once.
BLOCK = 1 << 16


def draws(seed: int, n: int) -> list[float]:
    """The selection's uniform numbers (Mersenne Twister, as Python's random module)."""
    r = random.Random(seed)
    return [r.random() for _ in range(n)]


def pick(weights: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Sources, by number, of uniform numbers: the first whose cumulative weight exceeds the number, the last if rounding leaves none."""
    if not all(0 < w < float("inf") for w in weights):
        raise ValueError("a weight that draws a source is positive and not infinite")  # such a source would never be drawn
    upto = np.cumsum(weights)
    return lambda u: np.minimum(np.searchsorted(upto, u * upto[-1], "right"), len(upto) - 1)


def _blocks(spark: SparkSession, seed: int, n: int, make: Callable[[int, np.ndarray], pa.RecordBatch], schema: str, block: int) -> DataFrame:
    """make(first, numbers) of each block of the first n draws. A task jumps to its first block and goes on from there, so nothing
    of the stream passes through the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, at = None, -1
        for batch in batches:
            for first in batch.column(0).to_pylist():
                if first != at:
                    r = twister.after(seed, first)
                at = min(first + block, n)
                yield make(first, r.random_sample(at - first))

    return spark.range(0, n, block).mapInArrow(rows, schema)


def drawn(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(chunk_id, u): n draws."""

    def make(first: int, u: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(u), dtype=np.int64)), pa.array(u)], ["chunk_id", "u"])

    return _blocks(spark, seed, n, make, "chunk_id long, u double", BLOCK)


def picks_of_blocks(spark: SparkSession, weights: Sequence[float], seed: int, n: int) -> DataFrame:
    """(block, source, picks, before): how often each source, by number, is drawn in each block of the first n draws and before it."""
    block, of = BLOCK, pick(weights)

    def make(first: int, u: np.ndarray) -> pa.RecordBatch:
        picks = np.bincount(of(u), minlength=len(weights))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(weights), first // block)), pa.array(np.arange(len(weights))), pa.array(picks.astype(np.int64))], ["block", "source", "picks"])

    counted = _blocks(spark, seed, n, make, "block long, source long, picks long", block)
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    return counted.withColumn("before", F.coalesce(F.sum("picks").over(ahead), F.lit(0)))


def draws_for_all(tokens: list[int], weights: list[float], seed: int, chunk: int, least: int = 0) -> int:
    """The number of draws, no fewer than least, after which every source has given all its tokens. Sources in order of id.

    Tasks count the picks of each block; the block in which a source has its last chunk is then looked through.
    """
    if not weights:
        return least
    spark, block, of = SparkSession.builder.getOrCreate(), BLOCK, pick(weights)
    need = {i: -(-t // chunk) for i, t in enumerate(tokens) if t > 0}
    n = int(max([1.2 * k * sum(weights) / weights[i] for i, k in need.items()], default=0)) + block
    while True:
        blocks = picks_of_blocks(spark, weights, seed, n)
        wanted = spark.createDataFrame([*need.items()], "source long, need long")
        last = blocks.join(F.broadcast(wanted), "source").where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("picks")))  # wanted: a row for each source
        found = last.select("source", "block", (F.col("need") - F.col("before")).alias("k")).collect()
        if len(found) == len(need):
            break
        n *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r["block"] * block + int(np.flatnonzero(of(twister.after(seed, r["block"] * block).random_sample(block)) == r["source"])[r["k"] - 1]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["place"])

    if not found:
        return least
    return max(least, spark.createDataFrame(found, "source long, block long, k long").mapInArrow(places, "place long").agg(F.max("place")).first()[0] + 1)


def derived_seed(seed: int, source: str, epoch: int, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}\0{source}\0{epoch}\0{purpose}".encode()).digest()[:8], "little")


def permutation(seed: int, source: str, epoch: int, purpose: str, n: int) -> np.ndarray:
    """The bit-exact PCG64 permutation of n shards or documents."""
    return np.random.Generator(np.random.PCG64(derived_seed(seed, source, epoch, purpose))).permutation(n)


def schedule(spark: SparkSession, sources: DataFrame, seed: int, chunks: int) -> DataFrame:
    """(chunk_id, source_id, rank). sources (source_id, weight): a few rows, in order of id.

    A chunk's rank is its place among the source's chunks in its block, after those of earlier blocks.
    """
    rows = sources.select("source_id", "weight").orderBy("source_id").collect()  # a row per source
    weights, block, of = [r.weight for r in rows], BLOCK, pick([r.weight for r in rows])
    names = pa.array([r.source_id for r in rows], pa.string())
    if not rows:
        return spark.createDataFrame([], "chunk_id long, source_id string, rank long")

    def make(first: int, u: np.ndarray) -> pa.RecordBatch:
        source = of(u)
        order = np.argsort(source, kind="stable")
        place = np.empty(len(u), dtype=np.int64)
        starts = np.searchsorted(source[order], np.arange(len(weights)))
        place[order] = np.arange(len(u)) - starts[source[order]]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(u), dtype=np.int64)), pa.array(np.full(len(u), first // block)), pa.array(source.astype(np.int64)), names.take(pa.array(source)), pa.array(place)], ["chunk_id", "block", "source", "source_id", "place"])

    picked = _blocks(spark, seed, chunks, make, "chunk_id long, block long, source long, source_id string, place long", block)
    before = picks_of_blocks(spark, weights, seed, chunks).select("block", "source", "before")
    return picked.join(before, ["block", "source"]).select("chunk_id", "source_id", (F.col("before") + F.col("place")).alias("rank"))


def portable_order(seed: int) -> Column:
    """An order of documents that SQL can state: by SHA-256 of seed, source, epoch and document."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "source_id", F.col("epoch").cast("string"), F.col("doc_seq").cast("string")).cast("binary"), 256)


def streams(lengths: DataFrame, plan: DataFrame, chunk: int, order: Column) -> DataFrame:
    """(source_id, epoch, doc_seq, start, end): documents in as many epochs as the plan needs, with their place in the stream.

    order gives strings; their first three characters cut a source's documents into blocks that are summed up one by one.
    """
    per = lengths.groupBy("source_id").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    needed = plan.groupBy("source_id").agg((F.max("rank") + 1).alias("n")).join(per, "source_id")
    epochs = needed.select("source_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") * chunk - 1) / F.col("tokens")).cast("int"))).alias("epoch"))
    ordered = lengths.join(epochs, "source_id").withColumn("__order", order)
    summed = running(ordered, ("source_id", "epoch"), ("__order", "doc_seq"), F.substring("__order", 1, 3), F.col("n_tokens"), "end")
    placed = summed.withColumn("end", F.col("end") + F.col("epoch") * F.col("tokens"))
    return placed.select("source_id", "epoch", "doc_seq", (F.col("end") - F.col("n_tokens")).alias("start"), "end")


def pieces(stream: DataFrame, plan: DataFrame, chunk: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, source_id, epoch, doc_seq, doc_offset, chunk_offset, n_tokens): what each chunk takes from which document.

    A document is listed under each rank that it touches, so ranges meet in an equi-join. also names more columns of the stream.
    """
    touched = stream.where("end > start").withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    low, high = F.greatest("start", F.col("rank") * chunk), F.least("end", (F.col("rank") + 1) * chunk)
    met = plan.join(touched, ["source_id", "rank"])
    return met.select("chunk_id", "source_id", "epoch", *also, "doc_seq", (low - F.col("start")).alias("doc_offset"), (low - F.col("rank") * chunk).alias("chunk_offset"), (high - low).alias("n_tokens"))


def first_locations(parts: DataFrame) -> DataFrame:
    """(chunk_id, source_id, epoch, doc_seq, doc_offset) of the first piece of each chunk."""
    return parts.where("chunk_offset = 0").select("chunk_id", "source_id", "epoch", "doc_seq", "doc_offset")


def token_chunks(parts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(chunk_id, source_id, tokens): pieces joined with the token arrays of their documents."""
    own = parts.join(tokens.select("source_id", "doc_seq", "tokens"), ["source_id", "doc_seq"])
    cut = F.slice("tokens", (F.col("doc_offset") + 1).cast("int"), F.col("n_tokens").cast("int"))
    return own.groupBy("chunk_id", "source_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_offset", cut.alias("t")))), lambda p: p["t"])).alias("tokens"))


def accounting(stream: DataFrame, plan: DataFrame, chunk: int) -> DataFrame:
    """(source_id, tokens, chunks, documents_completed). Documents without tokens count once a later read has passed them."""
    read = plan.groupBy("source_id").agg(F.count("*").alias("chunks")).withColumn("tokens", F.col("chunks") * chunk)
    passed = F.when(F.col("end") > F.col("start"), F.col("end") <= F.col("tokens")).otherwise(F.col("end") < F.col("tokens"))
    done = stream.join(read, "source_id").groupBy("source_id").agg(F.count_if(passed).alias("documents_completed"))
    return read.join(done, "source_id", "left").select("source_id", "tokens", "chunks", F.coalesce("documents_completed", F.lit(0)).alias("documents_completed"))


def composition(plan: DataFrame, chunk: int, per_step: int) -> DataFrame:
    """(step, source_id, tokens) of steps of per_step tokens over the chunks in order; the last step may be partial."""
    start = F.col("chunk_id") * chunk
    steps = plan.withColumn("step", F.explode(F.sequence(F.floor(start / per_step), F.floor((start + chunk - 1) / per_step))))
    inside = F.least(start + chunk, (F.col("step") + 1) * per_step) - F.greatest(start, F.col("step") * per_step)
    return steps.groupBy("step", "source_id").agg(F.sum(inside).alias("tokens"))


def missing_majors(steps: DataFrame, sources: DataFrame, within: int = COVERAGE_STEPS) -> DataFrame:
    """Major sources that no step below within has seen."""
    return sources.where("major").join(steps.where(F.col("step") < within).select("source_id"), "source_id", "left_anti").select("source_id")


def sequences(parts: DataFrame, chunk: int, length: int) -> DataFrame:
    """(seq_id, seq_offset, chunk_id, source_id, epoch, doc_seq, doc_offset, n_tokens): pieces cut at sequence boundaries."""
    start = F.col("chunk_id") * chunk + F.col("chunk_offset")
    wide = parts.withColumn("at", start).withColumn("seq_id", F.explode(F.sequence(F.floor(start / length), F.floor((start + F.col("n_tokens") - 1) / length))))
    low, high = F.greatest("at", F.col("seq_id") * length), F.least(F.col("at") + F.col("n_tokens"), (F.col("seq_id") + 1) * length)
    return wide.select("seq_id", (low - F.col("seq_id") * length).alias("seq_offset"), "chunk_id", "source_id", "epoch", "doc_seq", (F.col("doc_offset") + low - F.col("at")).alias("doc_offset"), (high - low).alias("n_tokens"))


def alignment(read: Column, pending: Column, step: Column, tokens_done: Column, per_step: int) -> Column:
    """Null if the cursor is aligned (read - pending = tokens_done = step * per_step), else what is wrong."""
    return F.when(tokens_done != step * per_step, "step and tokens differ").when(read - pending != tokens_done, "data cursor differs")
