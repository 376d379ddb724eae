"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before the library sees them: right before white space that follows something else.
No alternative of the split pattern matches white space after another character, and none looks behind, so the matches on
both sides are the same with and without the cut. Of a long white-space run all but the last character (at the end of a text:
all of it) is one match by itself, by the pattern's look-ahead, and goes to the merges directly, as the library's regular
expressions overflow on it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import arrow_map, fields, kept, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256", "decodes", "ids")
#: Unicode White_Space, the class the split pattern means by \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BOUNDARY = re.compile(f"[^{SPACE}](?=[{SPACE}])")
RUN = re.compile(f"[{SPACE}]{{1000,}}")
#: Characters handed to the library at once, up to the next safe boundary.
CHUNK = 1 << 16


def safe_parts(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters that can be encoded one by one."""
    start = 0
    while len(text) - start > CHUNK and (cut := BOUNDARY.search(text, start + CHUNK)):
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


class Coder:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text."""
        if len(text) <= 1000:
            return self.library.encode_ordinary(text)
        ids, start = [], 0
        for run in RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.plain(text[start : run.start()])
            ids += self.library._encode_single_piece(text[run.start() : end])
            start = end
        return ids + self.plain(text[start:]) if start else self.plain(text)

    def plain(self, text: str) -> list[int]:
        """Ids of a text without long white-space runs."""
        if len(text) <= CHUNK:
            return self.library.encode_ordinary(text)
        return [i for part in safe_parts(text) for i in self.library.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes of the ids; no character decoding takes place, so split characters survive."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def coder(rank_file: str, pattern: str = public_tokenizers.PATTERN) -> Coder:
    return Coder(rank_file, pattern)


def encode(df: DataFrame, keep: list[str], text: str = "text", rank_file: str | None = None, ids: bool = True) -> DataFrame:
    """The kept columns plus n_tokens, ids_sha256, decoded_sha256, decodes (the bytes come back) and, if asked for, ids.

    ids is binary: little-endian unsigned 32-bit integers. A null text counts as empty: no ids, digests of nothing.
    Repeated rows each give a row, an empty table none, texts of any length are coded whole; other columns of df are left out,
    whatever their names, and a kept column named as a result comes out as input_<name>.
    """
    path = rank_file or public_tokenizers.path(RANKS)
    chosen = df.select(*kept(df, keep, *RESULTS), df[text].alias("__text"))
    names = chosen.columns[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            count, ids_sha, text_sha, same, raw = [], [], [], [], []
            for t in texts_of(batch, "__text"):
                found = c.encode(t)
                coded, back = np.array(found, dtype="<u4").tobytes(), c.decode(found)
                count.append(len(found))
                ids_sha.append(hashlib.sha256(coded).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == t.encode())
                raw.append(coded if ids else None)
            out = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())] + [pa.array(raw, pa.binary())] * ids
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*names, "n_tokens", "ids_sha256", "decoded_sha256", "decodes", *["ids"] * ids])

    schema = ", ".join([*fields(chosen.schema)[:-1], "n_tokens long", "ids_sha256 string", "decoded_sha256 string", "decodes boolean"] + ["ids binary"] * ids)
    return arrow_map(chosen, rows, schema)


def decode(df: DataFrame, keep: list[str], ids: str = "ids", rank_file: str | None = None) -> DataFrame:
    """The kept columns plus bytes, the raw bytes of the ids column. Null ids give null, an empty table gives no row."""
    path = rank_file or public_tokenizers.path(RANKS)
    chosen = df.select(*kept(df, keep, "bytes"), df[ids].alias("__ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            raw = [None if x is None else c.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], [*batch.schema.names[:-1], "bytes"])

    return arrow_map(chosen, rows, ", ".join([*fields(chosen.schema)[:-1], "bytes binary"]))
