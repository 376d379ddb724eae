"""Shared grams of documents and an index: where a document's n-grams occur in a set of benchmark records.

Each gram of the index sets two bits in one word of a filter of fixed size, which is all that is sent to executors. One Arrow pass
over the documents rolls a hash over all their grams and hands on those whose bits are set; these few meet the index itself in a
semi join. Nothing depends on the index's size but how many grams pass the filter for nothing: 1 or 2 % at 16 bits for each gram.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.tables import arrow_map, gathered, spread

SCRIPTS = ("cjk", "latin")
#: 64-bit words of a script's filter (8 MB), whatever the index's size; both scripts' filters are all that executors get at once.
FILTER = 1 << 20
#: Characters or words whose hashes are rolled at once: a text of any length takes a worker no more.
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
HITS = pa.schema([("doc_id", pa.int64()), ("script", pa.string()), ("pos", pa.int64()), ("gram", pa.string()), ("n_grams", pa.int64())])
NEAR = pa.schema([("doc_id", pa.int64()), ("anchor", pa.string()), ("at", pa.int64()), ("around", pa.string())])


def exploded(df: DataFrame, id_: str = "doc_id", text: str = "text", scripts: tuple[str, ...] = SCRIPTS) -> DataFrame:
    """(id, script, pos, gram, n_grams) of every gram of the given granularities."""
    n = T.with_nfkc(df.select(id_, text), text)
    both = F.array(*(F.struct(F.lit(s).alias("script"), g.alias("grams")) for s, g in (("cjk", T.char_grams(F.col("nfkc"))), ("latin", T.word_grams(F.col("nfkc")))) if s in scripts))
    one = n.select(id_, F.explode(both).alias("x")).select(id_, "x.script", "x.grams")
    return one.select(id_, "script", F.posexplode("grams").alias("pos", "gram"), F.size("grams").cast("long").alias("n_grams")).select(id_, "script", F.col("pos").cast("long").alias("pos"), "gram", "n_grams")


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(0, n - 1), base, dtype=np.uint64)]), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(BASE)
    return h ^ (h >> np.uint64(29))


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n ids, each the difference of two running sums."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    size = 1 << max(10, (len(ids) - 1).bit_length())  # tables of powers in a few sizes
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ids * _powers(BASE, size)[: len(ids)], dtype=np.uint64)])
        return _mixed((run[n:] - run[:-n]) * _powers(pow(BASE, -1, 1 << 64), size)[: len(ids) - n + 1])


def char_ids(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def key_ids(keys: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=8).digest() for k in keys), dtype="<u8")


def _places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash, and its two bits there."""
    one = np.uint64(1)
    return (h >> np.uint64(40)) % np.uint64(size), (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63)))


def passing(items: str | list[bytes], n: int, own: np.ndarray) -> Iterator[int]:
    """Places of the runs of n characters or words that pass a filter, from one block after the other."""
    ids_of = char_ids if isinstance(items, str) else word_ids
    for first in range(0, len(items) - n + 1, BLOCK - n + 1):
        places, bits = _places(rolled(ids_of(items[first : first + BLOCK]), n), len(own))
        yield from (np.flatnonzero(own[places] & bits == bits) + first).tolist()


def filter_of(index: DataFrame, size: int = FILTER, lengths: dict[str, int] = {"cjk": T.CHAR_GRAM, "latin": T.WORD_GRAM}) -> dict[str, np.ndarray]:  # noqa: B006
    """Each script's filter, for grams of so many characters or words (0: whole keys). Tasks hash them; at most `size` words of each
    script reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scripts, hashes = batch.column("script").to_pylist(), []
            for script, gram in zip(scripts, batch.column("gram").to_pylist(), strict=True):
                ids = char_ids(gram) if script == "cjk" else word_ids(gram.encode().split())
                hashes.append(int(rolled(ids, n)[0] if (n := lengths[script]) else key_ids([gram])[0]))
            words, bits = _places(np.array(hashes, dtype=np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(scripts, pa.string()), pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], ["script", "word", "bits"])

    found = arrow_map(index.select("script", "gram"), rows, "script string, word long, bits long").groupBy("script", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = {s: np.zeros(size, dtype=np.uint64) for s in lengths}
    script = found.column("script").to_numpy(zero_copy_only=False)
    for s in lengths:
        own = script == s
        out[s][found.column("word").to_numpy()[own]] = found.column("bits").to_numpy()[own].view(np.uint64)
    return out


def candidates(df: DataFrame, filters: dict[str, np.ndarray], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Every gram of the documents that passes its script's filter: doc_id, script, pos, gram, n_grams of its script."""
    shared = df.sparkSession.sparkContext.broadcast({s: f for s, f in filters.items() if f.any()})  # two filters of a fixed size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                d, normal = d.as_py(), t.as_py() or ""
                if "cjk" in shared.value:
                    chars = "".join(normal.split())
                    n = len(chars) - T.CHAR_GRAM + 1
                    yield from ((d, "cjk", p, chars[p : p + T.CHAR_GRAM], n) for p in passing(chars, T.CHAR_GRAM, shared.value["cjk"]))
                if "latin" in shared.value:
                    words = normal.encode().translate(LETTERS).split()
                    n = len(words) - T.WORD_GRAM + 1
                    yield from ((d, "latin", p, b" ".join(words[p : p + T.WORD_GRAM]).decode(), n) for p in passing(words, T.WORD_GRAM, shared.value["latin"]))

    normal = T.with_nfkc(spread(df.select(df[id_].cast("long").alias("doc_id"), df[text].alias("text"))))
    return arrow_map(normal.select("doc_id", F.lower("nfkc")), lambda batches: gathered(found(batches), HITS), "doc_id long, script string, pos long, gram string, n_grams long")


def around(docs: DataFrame, anchors: DataFrame, n: int, reach: int, size: int = FILTER) -> DataFrame:
    """(doc_id, anchor, at, around): every n characters of a document that may be one of the anchors, and the text from reach before
    them to reach behind their start; at is their place in it.

    docs (doc_id, normal): normalised texts, looked through without white space and as words with one space between. Texts
    without any gram are left out.
    """
    filters = filter_of(anchors.select(F.lit("cjk").alias("script"), F.col("anchor").alias("gram")), size, {"cjk": n})
    shared = docs.sparkSession.sparkContext.broadcast(filters["cjk"])  # of a fixed size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = shared.value
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                d, normal = d.as_py(), t.as_py() or ""
                chars, words = "".join(normal.split()), normal.encode().translate(LETTERS).split()
                if len(chars) < T.CHAR_GRAM and len(words) < T.WORD_GRAM:
                    continue
                for text in (chars, b" ".join(words).decode()):
                    for p in passing(text, n, own):
                        first = max(0, p - reach)
                        yield d, text[p : p + n], p - first, text[first : p + reach]

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "normal"), lambda batches: gathered(found(batches), NEAR), "doc_id long, anchor string, at long, around string")


def keyed(df: DataFrame, keys: DataFrame, id_: str = "doc_id", text: str = "text", size: int = FILTER) -> DataFrame:
    """(doc_id, key): documents and their lines, as functions.text.key_of gives their keys, where these may be one of the keys."""
    shared = df.sparkSession.sparkContext.broadcast(filter_of(keys.select(F.lit("key").alias("script"), F.col("key").alias("gram")), size, {"key": 0})["key"])  # of a fixed size
    other = re.compile(f"[^{T.CJK[1:-1]}]+")

    def key_of(raw: str, normal: str) -> str:
        if not raw.isascii() and len(other.sub("", raw)) / len(raw) >= T.CJK_SHARE:
            return "".join(normal.split())
        return b" ".join(normal.encode().translate(LETTERS).split()).decode()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at, found = [], []
            for i, (raw, normal) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                raw, normal = raw.as_py() or "", normal.as_py() or ""
                # normal forms and lower case leave line ends as they are
                parts = {key_of(raw, normal)}.union(key_of(r, n) for r, n in zip(map(str.strip, raw.split("\n")), normal.split("\n"), strict=True))
                some = [k for k in parts if len(k) >= T.MIN_SHORT_KEY]
                places, bits = _places(key_ids(some), size)
                passed = np.flatnonzero(own[places] & bits == bits).tolist()
                at += [i] * len(passed)
                found += [some[p] for p in passed]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["doc_id", "key"])

    both = T.with_nfkc(spread(df.select(df[id_].alias("doc_id"), df[text].alias("text")))).select("doc_id", "text", F.lower("nfkc").alias("normal"))
    return arrow_map(both, rows, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, key string")


def hits(df: DataFrame, index: DataFrame, id_: str = "doc_id", text: str = "text", size: int = FILTER) -> DataFrame:
    """A row for each occurrence in df of a gram of the index (script, gram): doc_id, script, pos, gram, n_grams of its script."""
    own = index.select("script", "gram").distinct()
    return candidates(df, filter_of(own, size), id_, text).join(own, ["script", "gram"], "left_semi").select("doc_id", "script", "pos", "gram", "n_grams")


def joined_hits(df: DataFrame, index: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows by a join of all grams of the documents with the index."""
    return exploded(df, id_, text).join(index.select("script", "gram").distinct(), ["script", "gram"], "left_semi").select(F.col(id_).alias("doc_id"), "script", "pos", "gram", "n_grams")
