"""Training-order materialisation: every packed sequence gets a slot of a keyed permutation, and shards hold slots in order.

1. Texts are encoded and packed, end-of-document ids between them, into sequences of a fixed length. A sequence is known by
   the partition of the scan and its place there; the packed table is written before anything is numbered, so numbers survive
   lost executors.
2. A sequence's number is its place plus the sequences of earlier partitions (one count for each partition goes to the driver).
3. The slot is a balanced Feistel permutation of the number over the next even power of two, walked along its cycle until it
   falls below the number of sequences: a keyed bijection that needs neither a sort nor a table.
4. Rows are dealt by range of slots, several shards to a task where there are many, and written at once; the manifest that is
   returned is a table that was written with them. A shard is a file of fixed-stride records, so slot s lies at byte
   (s mod slots_per_shard) * stride of shard s div slots_per_shard, and a reader resumes at any slot by seeking.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RANKS, coder
from .common import Room, arrow_map, scratch, texts_of

#: Production parameters: tokens in a sequence, sequences in a shard (16 MB of two-byte ids), end-of-document id, key.
LENGTH, SLOTS, END, KEY = 1024, 8192, 50256, 20240607
ROUNDS = 6
#: Tasks that write shards at most; beyond as many shards each task writes several, one after the other.
TASKS = 20_000
#: Sequences that a packing worker holds before it hands them on.
HELD = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shifts and odd multipliers)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0..n-1, applied to numbers."""
    half = np.uint64(max(1, math.ceil(max(1, (n - 1).bit_length()) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, rank_file: str | None = None) -> DataFrame:
    """Sequences (part, place, doc_ids, n_tokens, ids as little-endian unsigned 16-bit integers, filled up with end).

    Documents follow one another within a partition, each closed by one end id; a null or empty text gives just that id. Only
    the last sequence of a partition is filled up. doc_ids has every document with ids in the sequence, nulls included.
    """
    path = rank_file or public_tokenizers.path(RANKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, place = coder(path), TaskContext.get().partitionId(), 0
        ids: list[int] = []
        starts: list[tuple[int, int | None]] = []  # where each document starts in ids

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal place, ids, starts
            n = math.ceil(len(ids) / length) if last else len(ids) // length
            flat = np.full(n * length, end, dtype="<u2")
            taken = min(len(ids), n * length)
            flat[:taken] = ids[:taken]
            docs, at = [], 0
            bounds = [*starts[1:], (len(ids), None)]
            for k in range(n):
                lo, hi = k * length, min((k + 1) * length, len(ids))
                while at < len(bounds) - 1 and bounds[at][0] <= lo:
                    at += 1
                stop = at
                while stop < len(starts) and starts[stop][0] < hi:
                    stop += 1
                docs.append([d for _, d in starts[at:stop]])
            sizes = [length] * n
            if last and n:
                sizes[-1] = len(ids) - (n - 1) * length
            raw = flat.tobytes()
            batch = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array(docs, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array([raw[2 * k * length : 2 * (k + 1) * length] for k in range(n)], pa.binary())], ["part", "place", "doc_ids", "n_tokens", "ids"])
            place += n
            ids = ids[taken:]
            keep = next((k for k in range(len(starts) - 1, -1, -1) if starts[k][0] <= taken), 0)
            starts = [(max(0, s - taken), d) for s, d in starts[keep:]] if ids else []
            return batch

        for batch in batches:
            for d, t in zip(batch.column("__id").to_pylist(), texts_of(batch, "__text"), strict=True):
                starts.append((len(ids), d))
                ids += c.encode(t)
                ids.append(end)
                if len(ids) >= HELD * length:
                    yield cut(False)
        if ids:
            yield cut(True)

    chosen = df.select(df[doc_id].cast("long").alias("__id"), df[text].alias("__text"))
    return arrow_map(chosen, rows, "part long, place long, doc_ids array<long>, n_tokens int, ids binary")


def training_order(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, slots_per_shard: int = SLOTS, end: int = END, key: int = KEY, rank_file: str | None = None, out: str | None = None) -> DataFrame:
    """Write the shards under out and return a row per sequence: slot, doc_ids, shard, byte_offset, n_tokens, ids_sha256.

    The shards are complete when the call returns; reading its result doesn't write them again. out, a path or a URI that all
    executors reach, defaults to a fresh folder under spark.checkpoint.dir. An empty table gives no shard and no row; repeated rows
    are packed one by one, texts of any length are coded whole, and other columns are left out, whatever their names. Slots are
    0..n-1, each once. Which sequence gets which slot depends on the key, the texts and how the scan is partitioned, nothing else.
    """
    spark, room = df.sparkSession, Room(df.sparkSession)
    table = room.stored(packed(df, doc_id, text, length, end, rank_file), "packed")
    counts = {r.part: r.n for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition of the scan
    base, n = {}, 0
    for part in sorted(counts):
        base[part] = n
        n += counts[part]
    shards = resolved(spark, out) if out else scratch(spark, "shards")
    names = ["slot", "doc_ids", "n_tokens", "ids"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard and batch: its records, compressed together, as they travel further than one by one."""
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.array([base[p] for p in batch.column("part").to_pylist()], dtype=np.int64) + batch.column("place").to_numpy()
            slots = slots_of(number, n, key)
            order = np.argsort(slots, kind="stable")
            whole = pa.RecordBatch.from_arrays([pa.array(slots), *(batch.column(c) for c in names[1:])], names).take(pa.array(order))
            shard = slots[order] // slots_per_shard
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            sent = []
            for lo, hi in zip(starts, [*starts[1:], len(shard)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(lo, hi))) for c in whole.columns], names))
                sent.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int64()), pa.array(sent, pa.binary())], ["shard", "records"])

    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Place the records of a shard, which arrive together, and write it: at most one shard is held."""
        fs, folder = pyarrow.fs.FileSystem.from_uri(shards)
        attempt = TaskContext.get().taskAttemptId()
        held: list[pa.RecordBatch] = []
        current = None

        def finish() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("slot")
            slots = table.column("slot").to_numpy()
            first = current * slots_per_shard
            if not np.array_equal(slots, np.arange(first, min(first + slots_per_shard, n))):
                raise ValueError(f"shard {current} doesn't have each of its slots once")
            records = table.column("ids").to_pylist()
            fs.create_dir(folder, recursive=True)
            name = f"{folder}/{shard_name(current)}"
            with fs.open_output_stream(f"{name}.{attempt}.part") as f:
                for r in records:
                    f.write(r)
            fs.move(f"{name}.{attempt}.part", name)
            return pa.RecordBatch.from_arrays([pa.array(slots), table.column("doc_ids").combine_chunks(), pa.array([current] * len(slots), pa.int64()), pa.array((slots - first) * stride), table.column("n_tokens").combine_chunks(), pa.array([hashlib.sha256(r).hexdigest() for r in records])], ["slot", "doc_ids", "shard", "byte_offset", "n_tokens", "ids_sha256"])

        for batch in batches:
            for shard, records in zip(batch.column("shard").to_pylist(), batch.column("records").to_pylist(), strict=True):
                if held and shard != current:
                    yield finish()
                    held = []
                current = shard
                held += pa.ipc.open_stream(records)
        if held:
            yield finish()

    schema = "slot long, doc_ids array<long>, shard long, byte_offset long, n_tokens int, ids_sha256 string"
    if not n:
        return spark.createDataFrame([], schema)
    files = math.ceil(n / slots_per_shard)
    each = math.ceil(files / TASKS)
    dealt = arrow_map(table, deal, "shard long, records binary").repartitionById(math.ceil(files / each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("shard")
    written = room.stored(arrow_map(dealt, write, schema), "order")
    room.clear(written)
    return written


def resolved(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would read it by, so that a path on the cluster's file system isn't each machine's own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(shards: str, start: int, count: int, length: int = LENGTH, slots_per_shard: int = SLOTS) -> Iterator[np.ndarray]:
    """Sequences from slot start on, read by seeking; fewer if the shards end before."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(shards)
    stride = 2 * length
    while count > 0:
        shard, place = divmod(start, slots_per_shard)
        if fs.get_file_info(f"{folder}/{shard_name(shard)}").type == pyarrow.fs.FileType.NotFound:
            return
        with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek(place * stride)
            raw = f.read(min(count, slots_per_shard - place) * stride)
        for k in range(0, len(raw), stride):
            yield np.frombuffer(raw[k : k + stride], "<u2")
        if len(raw) < min(count, slots_per_shard - place) * stride:
            return
        start, count = start + len(raw) // stride, count - len(raw) // stride
