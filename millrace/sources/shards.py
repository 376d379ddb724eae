"""Token shards (.bin: unsigned 16-bit ids, .idx: unsigned 64-bit offsets) as a Spark data source.

spark.dataSource.register(ShardSource); spark.read.format("token_shards").load(folder) gives (source_id, shard, doc_seq, tokens),
one partition per shard. Manifests may list shards under splits, under interleave.sources or in one flat list. Writing takes rows (source_id, doc_seq, tokens) and makes, of each task's rows, one shard per source,
named <source>-<split>-<job>-<task>.bin. Appending adds to the manifest, overwriting replaces what it lists and then removes those
shards. write_shards() puts each source's documents in order first.

A write is one file under _commits, named by time and job: what it adds and removes. The manifest is made from all of them, with
totals of the splits, the tokenizer and the training sources, by every writer after its own; a writer that finds other commits than
it has just put in makes it again. So the last manifest of writers that run at once has all their shards, on any file system that
moves files in one step. A manifest from elsewhere is taken over as the first commit.
Paths may be any URI that pyarrow's file systems know.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.functions.tables import bounded

SCHEMA = "source_id string, shard string, doc_seq long, tokens array<int>"
FORMAT, MANIFEST, COMMITS = "document-indexed-uint16-shards", "manifest.json", "_commits"
# End of document, size of the vocabulary.
EOD, VOCABULARY = 4, 49_152
#: Tokens handed to Spark at once, but for longer documents.
AT_ONCE = 1 << 20


def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def safe_path(name: str) -> str:
    """The name, if it stays inside the manifest's folder: not empty, not absolute, no step up, no scheme."""
    if not name or name.startswith(("/", "\\")) or "://" in name or ":" in name.split("/")[0] or ".." in re.split(r"[/\\]", name):
        raise ValueError(f"a shard path must lie inside its folder: {name!r}")
    return name


def checked(tokens: np.ndarray, offsets: np.ndarray, name: str) -> None:
    """Offsets start at 0, never fall, and end at the number of tokens."""
    if not offsets.size or offsets[0] != 0 or offsets[-1] != tokens.size:
        raise ValueError(f"offsets must run from 0 to the number of tokens: {name}")
    if (offsets[1:] < offsets[:-1]).any():
        raise ValueError(f"document offsets fall: {name}")


def manifest_of(path: str) -> dict | None:
    """The folder's manifest; None if it has none."""
    fs, folder = _open(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
        found = json.loads(f.read())
    lists = isinstance(found, dict) and (found.get("shards"), found.get("splits"), (found.get("interleave") or {}).get("sources"))
    if not lists or all(x is None for x in lists):
        raise ValueError(f"{MANIFEST} lists no shards: {path}")
    return found


def named_source(path: str, split: str) -> str:
    """The source in a shard's file name: what stands before -<split>-<number>.bin, or before the first hyphen."""
    name = re.split(r"[/\\]", path)[-1]
    found = re.fullmatch(rf"(.+)-{re.escape(split)}-\d+\.bin", name)
    return found[1] if found else name.rsplit(".", 1)[0].split("-", 1)[0]


def shard(said: dict | str, **more: object) -> dict:
    """A shard's declaration with its aliases settled."""
    said = {"path": said} if isinstance(said, str) else dict(said)
    said["path"] = said.get("path", said.pop("tokens_path", None))
    said["index"] = said.get("index", said.pop("index_path", None)) or f"{str(said['path']).removesuffix('.bin')}.idx"
    if not isinstance(said["path"], str):
        raise ValueError("a shard has no path")
    return more | said


def declared(manifest: dict, split: str | None) -> list[dict]:
    """Every shard that a manifest declares, of one split if asked for: those under splits, those of interleave.sources (which
    name the source, and belong to any split unless splits has them), or the flat list. Each path comes once."""
    out: dict[str, dict] = {}
    for name, v in (manifest.get("splits") or {}).items():
        for s in v.get("shards") or []:
            s = shard(s, split=name)
            out[s["path"]] = {"source_id": s.get("source") or named_source(s["path"], name)} | s
    for source in (manifest.get("interleave") or {}).get("sources") or []:
        for s in source.get("shards") or []:
            s = shard(s)
            out[s["path"]] = out.get(s["path"], {}) | s | {"source_id": source.get("source_id")}
    for s in manifest.get("shards") or []:
        s = shard(s)
        out[s["path"]] = out.get(s["path"], {}) | s
    return [s for s in out.values() if split is None or s.get("split") in (None, split)]


def _put(fs: pyarrow.fs.FileSystem, path: str, value: dict) -> None:
    """A JSON file that is there whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())
    fs.move(part, path)


def commits(fs: pyarrow.fs.FileSystem, folder: str) -> list[str]:
    """The commits of a folder, in order."""
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{folder}/{COMMITS}", allow_not_found=True))
    return sorted(i.base_name for i in found if i.base_name.endswith(".json"))


def begin(fs: pyarrow.fs.FileSystem, folder: str, manifest: dict | None) -> None:
    """Take over a manifest that was made elsewhere as the first commit."""
    if manifest is not None and not commits(fs, folder):
        members = {k: v for k, v in manifest.items() if k not in ("shards", "splits", "interleave")}
        sources = {s.get("source_id"): [s.get("weight", 1.0), s.get("major", True)] for s in (manifest.get("interleave") or {}).get("sources") or []}
        _put(fs, f"{folder}/{COMMITS}/{0:020d}-taken-over.json", {"add": declared(manifest, None), "remove": [], "members": members, "sources": sources, "tokenizer": manifest.get("tokenizer")})


def merged(found: list[dict]) -> dict:
    """The manifest of commits, in order: a shard of the same path is replaced, a source has the weight it was last given."""
    members: dict = {"schema_version": 1, "format": FORMAT, "eod_token_id": EOD}
    shards: dict[str, dict] = {}
    said: dict[str, list] = {}
    for c in found:
        members |= c.get("members") or {}
        if own := c.get("tokenizer"):
            if members.setdefault("tokenizer", own).get("sha256") != own.get("sha256"):
                raise ValueError("the folder was made with another tokenizer")
        for path in c["remove"]:
            shards.pop(path, None)
        shards |= {s["path"]: s for s in c["add"]}
        said |= c.get("sources") or {s["source_id"]: [c["weight"], c["major"]] for s in c["add"] if c["split"] == "train"}
    listed = [shards[k] for k in sorted(shards)]
    splits = {}
    for name in sorted({s.get("split") or "train" for s in listed}):
        own = [s for s in listed if (s.get("split") or "train") == name]
        counted = {k: sum(s[k] for s in own) for k in ("tokens", "documents") if all(k in s for s in own)}
        splits[name] = counted | {"shards": own}
    train = (splits.get("train") or {}).get("shards", [])
    sources = [{"source_id": k, "weight": w, "major": m, "shards": own} for k, (w, m) in sorted(said.items()) if (own := [s for s in train if s.get("source_id") == k])]
    return members | {"shards": listed, "splits": splits, "interleave": {"sources": sources}}


def settle(fs: pyarrow.fs.FileSystem, folder: str) -> dict:
    """Write the manifest of all commits, again and again until no commit has come in between."""
    while True:
        names, found = commits(fs, folder), []
        for n in names:
            with fs.open_input_file(f"{folder}/{COMMITS}/{n}") as f:
                found.append(json.loads(f.read()))
        manifest = merged(found)
        _put(fs, f"{folder}/{MANIFEST}", manifest)
        if commits(fs, folder) == names:
            return manifest


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self.options["path"], self.options.get("split"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(self.options["path"], overwrite, self.options.get("split", "train"), dict(self.options))


class ShardReader(DataSourceReader):
    """Reads what the manifest lists (of one split, if asked for) and checks its counts; without a manifest every pair of files."""

    def __init__(self, path: str, split: str | None = None):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        if (manifest := manifest_of(self.path)) is not None:
            listed = declared(manifest, self.split)
        else:
            fs, folder = _open(self.path)
            names = sorted(i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if i.base_name.endswith(".bin"))
            listed = [{"path": n, "index": f"{n[:-4]}.idx"} for n in names]
        return [InputPartition(s) for s in listed] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if (said := partition.value) is None:
            return
        fs, folder = _open(self.path)
        name, raw = safe_path(said["path"]), {}
        for key, width in (("path", 2), ("index", 8)):
            with fs.open_input_file(f"{folder}/{safe_path(said[key])}") as f:
                raw[key] = f.read()
            if len(raw[key]) % width:
                raise ValueError(f"{said[key]} isn't a whole number of {width}-byte values")
        tokens, offsets = np.frombuffer(raw["path"], "<u2"), np.frombuffer(raw["index"], "<u8").astype(np.int64)
        checked(tokens, offsets, name)
        n = len(offsets) - 1
        for what, have in (("tokens", tokens.size), ("documents", n)):
            if said.get(what, have) != have:
                raise ValueError(f"{name} has {have} {what}, the manifest {said[what]}")
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
            flat = pa.array(tokens[offsets[at] : offsets[stop]].astype(np.int32))
            rows = pa.ListArray.from_arrays(pa.array((offsets[at : stop + 1] - offsets[at]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array([said.get("source_id")] * (stop - at), pa.string()), pa.array([name[:-4]] * (stop - at)), pa.array(np.arange(at, stop)), rows], ["source_id", "shard", "doc_seq", "tokens"])
            at = stop


@dataclass
class Written(WriterCommitMessage):
    #: Manifest entries, each with the temporary names of its files.
    shards: list[dict] = field(default_factory=list)


class _Shard:
    """A shard that is being written."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, name: str, attempt: int):
        self.fs, self.name = fs, name
        self.stem = f"{folder}/{name}.{attempt}"
        self.offsets, self.digest = [0], hashlib.sha256()
        self.file = fs.open_output_stream(f"{self.stem}.bin.tmp")

    def add(self, ids: np.ndarray) -> None:
        if ids.size and (ids.min() < 0 or ids.max() > 65535):
            raise ValueError("a token id doesn't fit 16 bits")
        raw = ids.astype("<u2").tobytes()
        self.file.write(raw)
        self.digest.update(raw)
        self.offsets.append(self.offsets[-1] + ids.size)

    def entry(self) -> dict:
        self.file.close()
        index = np.array(self.offsets, dtype="<u8").tobytes()
        with self.fs.open_output_stream(f"{self.stem}.idx.tmp") as f:
            f.write(index)
        return {"path": f"{self.name}.bin", "index": f"{self.name}.idx", "tokens": self.offsets[-1], "documents": len(self.offsets) - 1, "sha256": self.digest.hexdigest(), "index_sha256": hashlib.sha256(index).hexdigest(), "stem": self.stem}


class ShardWriter(DataSourceArrowWriter):
    """Options: split, and of its sources weight (1) and minor (false); tokenizer and tokenizer_sha256, which a folder has one of."""

    def __init__(self, path: str, overwrite: bool = False, split: str = "train", options: dict[str, str] | None = None):
        self.path, self.overwrite, self.split, self.job = path, overwrite, split, uuid.uuid4().hex[:12]
        said = options or {}
        self.weight, self.major = float(said.get("weight", 1)), said.get("minor", "false").lower() != "true"
        if not 0 < self.weight < float("inf"):
            raise ValueError("a source's weight must be finite and positive")
        self.tokenizer = {"path": said.get("tokenizer", ""), "sha256": said["tokenizer_sha256"], "vocab_size": VOCABULARY} if said.get("tokenizer_sha256") else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        context, open_ = TaskContext.get(), {}
        for batch in iterator:
            tokens = batch.column("tokens")
            if tokens.values.null_count:
                raise ValueError("a token id is null")
            ids, offsets = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()  # a null list is empty
            for i, source in enumerate(batch.column("source_id").to_pylist()):
                if source not in open_:
                    if not re.fullmatch(r"[A-Za-z0-9_.-]+", source or "") or ".." in source:
                        raise ValueError(f"a source id must be made of letters, digits, '_', '.' and '-': {source!r}")
                    open_[source] = _Shard(fs, folder, f"{source}-{self.split}-{self.job}-{context.partitionId():05d}", context.taskAttemptId())
                open_[source].add(ids[offsets[i] : offsets[i + 1]])
        return Written([{"source_id": s, "split": self.split} | x.entry() for s, x in open_.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Rename every shard, write the commit, then the manifest, and only then remove what an overwrite replaces. Names hold the
        job, so no shard of another write is touched; a write that is interrupted before its commit leaves things as they were."""
        fs, folder = _open(self.path)
        fs.create_dir(f"{folder}/{COMMITS}", recursive=True)
        begin(fs, folder, manifest_of(self.path))
        before = declared(manifest_of(self.path) or {}, None)
        new = []
        for m in messages:
            for s in m.shards if m is not None else ():
                stem = s.pop("stem")
                fs.move(f"{stem}.bin.tmp", f"{folder}/{s['path']}")
                fs.move(f"{stem}.idx.tmp", f"{folder}/{s['index']}")
                new.append(s)
        if not new and not (self.overwrite and before):
            return
        name = f"{time.time_ns():020d}-{self.job}.json"
        removed = [s["path"] for s in before] if self.overwrite else []
        _put(fs, f"{folder}/{COMMITS}/{name}", {"add": new, "remove": removed, "split": self.split, "weight": self.weight, "major": self.major, "tokenizer": self.tokenizer})
        try:
            settle(fs, folder)
        except ValueError:
            fs.delete_file(f"{folder}/{COMMITS}/{name}")
            settle(fs, folder)
            raise
        for s in before if self.overwrite else ():
            for name in (s["path"], s["index"]):
                if fs.get_file_info(f"{folder}/{safe_path(name)}").type != pyarrow.fs.FileType.NotFound:
                    fs.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove all files of this job, those of failed tasks too."""
        fs, folder = _open(self.path)
        for i in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
            if f"-{self.job}-" in i.base_name:
                fs.delete_file(i.path)


def write_shards(df: DataFrame, path: str, split: str = "train", mode: str = "append", **options: str) -> None:
    """Write (source_id, doc_seq, tokens) with each source's documents in order of doc_seq within a shard.

    Rows are dealt by range of source and document, so that a large source is many shards. Without rows there is nothing to train
    on, which is an error.
    """
    if df.isEmpty():
        raise ValueError("there are no documents to write")
    df.sparkSession.dataSource.register(ShardSource)
    bounded(df.sparkSession)
    ordered = df.select("source_id", "doc_seq", "tokens").repartitionByRange("source_id", "doc_seq").sortWithinPartitions("source_id", "doc_seq")
    ordered.write.format("token_shards").options(split=split, **options).mode(mode).save(path)
