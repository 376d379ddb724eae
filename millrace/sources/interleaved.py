"""The interleaved stream of a folder of token shards as a Spark streaming source, which resumes at any chunk.

spark.dataSource.register(InterleavedSource); spark.readStream.format("interleaved_tokens") with the options path, seed, chunk
(tokens), chunks (where the stream ends), batch (chunks at once), tasks and split gives (chunk_id, source_id, shard, document,
offset, tokens): full chunks, and where in which document each begins.

An offset is the number of chunks read and how often each source has been drawn for them. No cursor walks through documents: a
chunk's place among its source's chunks gives its place in the source's stream, whose orders of shards and documents follow from
the seed. Offsets hold the contract of the order too (its name, seed, chunk and the sources' fingerprint), and Spark keeps them in
the query's checkpoint: on a restart it hands the last one back before it plans anything, and another contract is refused.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions import twister
from millrace.operators.interleave import pick
from millrace.operators.orders import document_order, shard_order
from millrace.operators.packing import MAJOR_SHARE

from . import shards as S

SCHEMA = "chunk_id long, source_id string, shard int, document long, offset long, tokens array<int>"
# Fixed value: the name of this order.
ORDER = "source_balanced_interleave_v1"
#: Tokens handed to Spark at once, orders of shards and documents that a task remembers.
AT_ONCE, REMEMBERED = 1 << 20, 64


@dataclass(frozen=True)
class Source:
    source_id: str
    weight: float
    major: bool
    #: (path, index, tokens, documents) of each shard.
    shards: tuple[tuple[str, str, int, int], ...]

    @property
    def tokens(self) -> int:
        return sum(s[2] for s in self.shards)


def _sized(fs: pyarrow.fs.FileSystem, folder: str, said: dict) -> tuple[str, str, int, int]:
    """A shard whose files are there, hold whole numbers of values, and as many as declared."""
    counts = []
    for key, width, what, less in (("path", 2, "tokens", 0), ("index", 8, "documents", 1)):
        info = fs.get_file_info(f"{folder}/{S.safe_path(said[key])}")
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(f"a shard's file is missing: {said[key]}")
        if info.size % width:
            raise ValueError(f"{said[key]} isn't a whole number of {width}-byte values")
        counts.append(info.size // width - less)
        if said.get(what, counts[-1]) != counts[-1]:
            raise ValueError(f"{said[key]} has {counts[-1]} {what}, the manifest says {said[what]}")
    return said["path"], said["index"], *counts


def sources_of(path: str, split: str = "train", least: float = MAJOR_SHARE) -> list[Source]:
    """The sources of a folder: as its manifest declares them, in that order, or else by the shards' names, by share of tokens."""
    manifest = S.manifest_of(path)
    if manifest is None:
        raise FileNotFoundError(f"{path} has no {S.MANIFEST}")
    fs, folder = S._open(path)
    if (listed := (manifest.get("interleave") or {}).get("sources")) is not None:
        out = []
        for s in listed:
            if not s.get("source_id") or s.get("major") is None or s.get("weight") is None or not s.get("shards"):
                raise ValueError(f"a source needs an id, a weight, shards, and major as true or false: {s.get('source_id')!r}")
            out.append(Source(s["source_id"], float(s["weight"]), bool(s["major"]), tuple(_sized(fs, folder, S.shard(x)) for x in s["shards"])))
    else:
        if manifest.get("format") != S.FORMAT:
            raise ValueError(f"without sources the format must be {S.FORMAT}")
        grouped: dict[str, list] = {}
        for s in S.declared(manifest, split):
            grouped.setdefault(s.get("source_id") or S.named_source(s["path"], split), []).append(_sized(fs, folder, s))
        total = sum(x[2] for own in grouped.values() for x in own) or 1
        shares = {k: sum(x[2] for x in own) / total for k, own in grouped.items()}
        out = [Source(k, shares[k], shares[k] >= least, tuple(own)) for k, own in sorted(grouped.items())]
    if not out or len({s.source_id for s in out}) != len(out):
        raise ValueError("there must be sources, each with an id of its own")
    if any(not s.tokens or not (0 < s.weight < math.inf) for s in out):
        raise ValueError("every source needs tokens and a finite, positive weight")
    return out


def fingerprint(sources: list[Source]) -> str:
    return hashlib.sha256(json.dumps([[s.source_id, s.weight, s.major, s.shards] for s in sources]).encode()).hexdigest()


@dataclass
class Stretch(InputPartition):
    """Chunks first to end, before which each source has been drawn so often."""

    first: int
    end: int
    picks: list[int]


class Streams:
    """Reads stretches of the sources' endless streams."""

    def __init__(self, path: str, sources: list[Source], seed: int, chunk: int):
        self.path, self.sources, self.seed, self.chunk = path, sources, seed, chunk
        self.order = functools.lru_cache(REMEMBERED)(self._order)
        self.documents = functools.lru_cache(REMEMBERED)(self._documents)

    def _order(self, source: int, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        """The shards of an epoch, and where each begins."""
        s = self.sources[source]
        order = shard_order(self.seed, s.source_id, epoch, len(s.shards))
        sizes = np.array([s.shards[k][2] for k in order], dtype=np.int64)
        return order, np.cumsum(sizes) - sizes

    def _documents(self, source: int, epoch: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents of a shard that have tokens, in order: number, place in the file, and where each begins in the order."""
        s = self.sources[source]
        fs, folder = S._open(self.path)
        name, index, tokens, _ = s.shards[shard]
        with fs.open_input_file(f"{folder}/{index}") as f:
            offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
        if not offsets.size or offsets[0] != 0 or offsets[-1] != tokens or (offsets[1:] < offsets[:-1]).any():
            raise ValueError(f"offsets must run from 0 to the number of tokens and never fall: {index}")
        order = document_order(self.seed, s.source_id, epoch, shard, len(offsets) - 1)
        lengths = np.diff(offsets)[order]
        some = lengths > 0
        order, lengths = order[some], lengths[some]
        return order, offsets[order], np.cumsum(lengths) - lengths

    def read(self, source: int, rank: int) -> tuple[tuple[int, int, int], np.ndarray]:
        """((shard, document, offset) of its first token, tokens) of a source's chunk."""
        s, total = self.sources[source], self.sources[source].tokens
        fs, folder = S._open(self.path)
        at, end, location, out = rank * self.chunk, (rank + 1) * self.chunk, None, []
        while at < end:
            epoch, place = divmod(at, total)
            order, begins = self.order(source, epoch)
            k = int(np.searchsorted(begins, place, "right")) - 1
            shard = int(order[k])
            numbers, files, starts = self.documents(source, epoch, shard)
            size = s.shards[shard][2]
            place -= int(begins[k])
            with fs.open_input_file(f"{folder}/{s.shards[shard][0]}") as f:
                d = int(np.searchsorted(starts, place, "right")) - 1
                while at < end and place < size:
                    upto = int(starts[d + 1]) if d + 1 < len(starts) else size
                    n, offset = min(upto - place, end - at), place - int(starts[d])
                    location = location or (shard, int(numbers[d]), offset)
                    f.seek(2 * (int(files[d]) + offset))
                    got = np.frombuffer(f.read(2 * n), "<u2")
                    if len(got) != n:
                        raise ValueError(f"{s.shards[shard][0]} ends early")
                    out.append(got)
                    at, place, d = at + n, place + n, d + 1
        return location, np.concatenate(out)


class InterleavedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "interleaved_tokens"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return InterleavedReader(self.options)


class InterleavedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.seed, self.chunk = int(options["seed"]), int(options["chunk"])
        self.end, self.batch, self.tasks = int(options["chunks"]), int(options.get("batch", 1024)), int(options.get("tasks", 8))
        if min(self.chunk, self.batch, self.tasks) < 1:
            raise ValueError("chunk, batch and tasks must be positive")
        self.sources = sources_of(self.path, options.get("split", "train"))
        self.contract = {"data_order_contract": ORDER, "seed": self.seed, "max_chunk_tokens": self.chunk, "source_fingerprint": fingerprint(self.sources)}
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"chunk": 0, "picks": [0] * len(self.sources), "contract": self.contract}

    def _after(self, start: dict, end: int) -> dict:
        """The offset at chunk end. Counts draws in blocks."""
        of, r = pick([s.weight for s in self.sources]), twister.after(self.seed, start["chunk"])
        picks, left = np.array(start["picks"], dtype=np.int64), end - start["chunk"]
        while left > 0:
            picks += np.bincount(of(r.random_sample(min(left, 1 << 16))), minlength=len(picks))
            left -= 1 << 16
        return {"chunk": end, "picks": picks.tolist(), "contract": self.contract}

    def latestOffset(self) -> dict:
        return self._after(self.at, max(self.at["chunk"], min(self.end, self.at["chunk"] + self.batch)))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Stretches of about equal numbers of chunks. After a restart, the first call has the checkpoint's offset as start."""
        for key, value in self.contract.items():
            if start["contract"].get(key) != value:
                raise ValueError(f"the stream was begun with another {key}")
        n, out, at = end["chunk"] - start["chunk"], [], start
        for k in range(min(self.tasks, n)):
            upto = self._after(at, start["chunk"] + n * (k + 1) // min(self.tasks, n))
            out.append(Stretch(at["chunk"], upto["chunk"], at["picks"]))
            at = upto
        self.at = end
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        of, streams = pick([s.weight for s in self.sources]), Streams(self.path, self.sources, self.seed, self.chunk)
        drawn = of(twister.after(self.seed, partition.first).random_sample(partition.end - partition.first)).tolist()
        picks, rows = list(partition.picks), []
        for k, source in enumerate(drawn):
            rows.append((partition.first + k, self.sources[source].source_id, *streams.read(source, picks[source])))
            picks[source] += 1
            if len(rows) * self.chunk >= AT_ONCE or k == len(drawn) - 1:
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * self.chunk + 1, self.chunk, dtype=np.int32)), pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32)))
                where = [pa.array([r[2][i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), *where, tokens], ["chunk_id", "source_id", "shard", "document", "offset", "tokens"])
                rows = []


def stream(spark: SparkSession, path: str, seed: int, chunk: int, chunks: int, batch: int = 1 << 16, tasks: int | None = None) -> DataFrame:
    """The streaming DataFrame of the folder's first so many chunks; batch of them are planned at once, in so many tasks."""
    spark.dataSource.register(InterleavedSource)
    options = {"path": path, "seed": seed, "chunk": chunk, "chunks": chunks, "batch": batch, "tasks": tasks or spark.sparkContext.defaultParallelism}
    return spark.readStream.format("interleaved_tokens").options(**options).load()


def to_the_end(read: DataFrame, out: str, checkpoint: str, chunks: int, batch: int = 1 << 16) -> None:
    """Run a stream's batches into a Parquet table, one after the other."""
    for _ in range(-(-chunks // batch)):
        read.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
