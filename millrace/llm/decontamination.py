"""Benchmark decontamination by greedy string tiling, which catches passages in any order.

1. Documents and items that share a seed (LEAST consecutive tokens, by rolling hash) are paired.
2. Within a pair the longest common runs of unmarked tokens are found by running Karp-Rabin (hashes of windows whose length
   falls from pass to pass), marked, and looked for again, until no run of LEAST tokens is left.
3. The share of the item's tokens under tiles is its coverage; from THRESHOLD on the document is contaminated.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fields, kept, texts_of

TOKEN = re.compile(r"\w+")
#: Least tokens of a tile (and of a seed), and least coverage of an item.
LEAST, THRESHOLD = 5, 0.5
#: Characters of benchmark text broadcast at once; a larger benchmark is taken in blocks of this size, each against all rows.
BLOCK = 16_000_000
BASE = 0x9E3779B97F4A7C15
#: Pairs of equal windows looked at together.
PAIRS = 1 << 20
MATCH = "array<struct<item_id:long,coverage:double,n_tiles:int,longest:int>>"


class _Ids(dict):
    """Hashes of recent words; at most 65,536 words of up to 64 characters, some 10 MB."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = h
        return h


IDS = _Ids()


def tokens(text: str) -> np.ndarray:
    """64-bit ids of the words (letters, digits, underscores; lower case) of a whole text."""
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(IDS.__getitem__, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(0, n - 1), base, dtype=np.uint64)]), dtype=np.uint64)


def seeds(ids: np.ndarray, n: int = LEAST) -> np.ndarray:
    """Hashes of all windows of n ids. They roll: each is the difference of two running sums, whatever n is."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ids * _powers(BASE, len(ids)), dtype=np.uint64)])
        h = (run[n:] - run[:-n]) * _powers(pow(BASE, -1, 1 << 64), len(ids) - n + 1)
        return h ^ (h >> np.uint64(29))


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length): greedily the longest first, none overlapping on either side."""
    free_doc, free_item = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(doc), len(item)) // 2)
    while True:
        found = _matches(doc, item, free_doc, free_item, size)
        if found and found[0][0] > 2 * size:
            size = found[0][0]
            continue
        marked = False
        for n, i, j in found:
            if free_item[i : i + n].all() and free_doc[j : j + n].all():
                free_item[i : i + n] = free_doc[j : j + n] = False
                out.append((i, j, n))
                marked = True
        if marked:  # what is left of runs that a tile has cut may still be long enough
            continue
        if size == least:
            return out
        size = max(least, size // 2)


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least size free tokens as (length, start in item, start in doc), longest first, ties by place."""
    of_item, h_item = _windows(item, free_item, size)
    of_doc, h_doc = _windows(doc, free_doc, size)
    if not of_item.size or not of_doc.size:
        return []
    order = np.argsort(h_item, kind="stable")
    of_item, h_item = of_item[order], h_item[order]
    lo, hi = np.searchsorted(h_item, h_doc, "left"), np.searchsorted(h_item, h_doc, "right")
    ends = np.cumsum(hi - lo)
    found, at = set(), 0
    while at < len(of_doc):  # windows by their pairs, about PAIRS at once
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = (hi - lo)[at:stop]
        j = np.repeat(of_doc[at:stop], n)
        i = of_item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)]
        inside = (i > 0) & (j > 0) & free_item[i - 1] & free_doc[j - 1] & (item[i - 1] == doc[j - 1])  # of a run that starts before
        for i, j in zip(i[~inside].tolist(), j[~inside].tolist(), strict=True):
            most = min(len(item) - i, len(doc) - j)
            off = np.flatnonzero((item[i : i + most] != doc[j : j + most]) | ~free_item[i : i + most] | ~free_doc[j : j + most])
            n = int(off[0]) if off.size else most
            if n >= size:
                found.add((n, i, j))
        at = stop
    return sorted(found, key=lambda m: (-m[0], m[1], m[2]))


def _windows(ids: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows without a marked token."""
    if len(ids) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    open_ = np.flatnonzero(taken[size:] == taken[:-size])
    return open_, seeds(ids, size)[open_]


class Index:
    """Seeds of a block of items: sorted hashes, the items of each, and a small table that rules most windows out."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.ids = [i for i, _ in items]
        self.items = [tokens(t) for _, t in items]
        self.least = least
        hashes = [np.unique(seeds(x, least)) for x in self.items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[(self.seeds >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def matches(self, text: str, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, n_tiles, longest) of the items that a whole text covers enough of, by item."""
        doc = tokens(text)
        h = seeds(doc, self.least)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not at.size or not self.seeds.size:
            return []
        lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
        hits: dict[int, list[int]] = {}
        for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in self.owner[a:b].tolist():
                hits.setdefault(k, []).append(p)
        out = []
        for k, places in sorted(hits.items()):
            item = self.items[k]
            if self.least * len(places) < threshold * len(item):
                continue  # even apart from one another these seeds cover too little
            tiles = tile(self.covered(doc, places), item, self.least)
            share = sum(n for *_, n in tiles) / len(item)
            if share >= threshold:
                out.append((self.ids[k], share, len(tiles), max(n for *_, n in tiles)))
        return out

    def covered(self, doc: np.ndarray, places: list[int]) -> np.ndarray:
        """The tokens under shared seeds, all that a tile can consist of; a mark that is no word stands between runs."""
        parts, start, end = [], places[0], places[0]
        for p in [*places[1:], None]:
            if p is None or p > end + 1:
                parts += [doc[start : end + self.least], np.array([len(parts)], dtype=np.uint64)]
                start = p
            end = p
        return np.concatenate(parts)


#: This worker's indexes, by broadcast; of the last few blocks.
INDEXES: OrderedDict[str, Index] = OrderedDict()


@dataclass(frozen=True)
class Block:
    id: str
    broadcast: Broadcast

    @property
    def value(self) -> list[tuple[int, str]]:
        return self.broadcast.value


def _index(items: Block, least: int) -> Index:
    """The index of a broadcast block, built once in a worker."""
    if (found := INDEXES.get(items.id)) is None:
        found = INDEXES[items.id] = Index(items.value, least)
        while len(INDEXES) > 4:
            INDEXES.popitem(last=False)
    return found


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> list[DataFrame]:
    """The benchmark in blocks of about so many characters, by hash of the item."""
    b = benchmark.select(benchmark[item_id].cast("long").alias("id"), F.coalesce(benchmark[text], F.lit("")).alias("text"))
    total = b.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = int(total // size) + 1
    return [b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else b for k in range(n)]


def tiled(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The kept columns of every row plus matches: the items it covers, with coverage, number of tiles and the longest.

    Null and empty texts match nothing, items of fewer than least tokens are matched by nothing, an empty benchmark neither.
    Repeated rows each give a row, an empty table none; repeated items each give a match. Texts of any length are read whole. A
    kept column called matches comes out as input_matches.
    """
    spark = df.sparkSession
    out = df.select(*kept(df, keep, "matches", "__text"), df[text].alias("__text"), F.array().cast(MATCH).alias("matches"))
    for part in blocks(benchmark, item_id, item_text, block):
        items = [(r.id, r.text) for r in part.orderBy("id", "text").collect()]
        shared = spark.sparkContext.broadcast(items)  # at most about block characters

        def rows(batches: Iterator[pa.RecordBatch], shared=Block(uuid.uuid4().hex, shared)) -> Iterator[pa.RecordBatch]:
            index = _index(shared, least)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())]))
            for batch in batches:
                found = []
                for t, before in zip(texts_of(batch, "__text"), batch.column("matches").to_pylist(), strict=True):
                    found.append((before or []) + [dict(zip(("item_id", "coverage", "n_tiles", "longest"), m, strict=True)) for m in index.matches(t, threshold)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], batch.schema.names)

        out = arrow_map(out, rows, ", ".join(fields(out.schema)))
    return out.drop("__text")


def leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, coverage, n_tiles, longest, contaminated (true)."""
    return tiled(df, benchmark, [doc_id], **how).select(doc_id, F.inline("matches")).withColumn("contaminated", F.lit(True))
