"""Cross-tokenizer alignment: where two tokenizers cut a text at the same byte, and which of their tokens meet in between.

1. A text (with a space before it) is cut into units: right before white space that follows something else, and between a letter
   and a mark, unless a piece of the second vocabulary has such characters side by side. Neither tokenizer joins anything across
   such a place, so units are encoded one by one, each new spelling once.
2. The token ends of all new units are marked in two packed bitsets over their bytes. The AND of both has the shared cuts, and
   popcounts (running sums over bytes, a masked byte at the end) rank each cut among either tokenizer's tokens: the token ranges
   of each group. Links are its ids of one side by those of the other, with how often each pair occurs.
3. A document's figures are sums over its units. Its distinct linked pairs are written with it, and counted over all documents.
4. Links meet the counts of their pairs: the most frequent pairs (at most HOT, by classes of counts) are broadcast, all others
   are joined. Pairs beyond HOT are each held by a small share of the documents, so none makes a hot key.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, Coder
from .common import Room, arrow_map, texts_of
from .token_counts import byte_letters

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are broadcast at most (12 bytes each).
HOT = 1 << 18
#: Bytes of remembered units, pairs of ids made at once.
REMEMBERED, PAIRS = 128 << 20, 1 << 20
MARK, LETTER, MARKS = "▁", r"[^\W\d_]", "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
SPACES = {c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c)}
#: A word that is put between units and left out again.
GUARD = " a"
DOCUMENT = "part long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel(Coder):
    """A byte-level BPE model of a tokenizers file, with special strings as plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        at = -1
        for m in said["model"]["merges"]:  # the library wants ids in the order of merges
            a, b = m.split(" ") if isinstance(m, str) else m
            if (i := said["model"]["vocab"][a + b]) <= at:
                raise ValueError(f"ids don't follow the order of merges: {path}")
            at = i
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw


class Pieces:
    """A sentencepiece model with a space before each text; its bytes by id, and where texts can be cut for it."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        whole = "\x00".join(n for i, n in enumerate(names) if not self.library.is_byte(i))
        if any(MARK in n.lstrip(MARK) for n in names) or "\n" in whole:
            raise ValueError(f"a piece goes on behind a space or a line's end: {path}")  # texts can't be cut there then
        marks = re.escape("".join(c for c in MARKS if not re.search(LETTER + re.escape(c), whole)))
        inside = re.escape("".join(c for c in sorted(SPACES - set(" \n")) if c in whole))  # white space at which a unit goes on
        letters = f"{LETTER}++(?![{marks}])" if marks else f"{LETTER}++"
        part = f"(?:(?!{LETTER})[^{SPACE}])*+(?:{letters}(?:(?!{LETTER})[^{SPACE}])*+)*+{LETTER}*+"
        self.unit = re.compile(f"[{SPACE}]*+{part}" + (f"(?:[{inside}][{SPACE}]*+{part})*+" if inside else ""))
        self.before = self.library.encode("\n")
        self.space = self.library.encode("a ")[len(self.library.encode("a")) :]

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units. The library puts a space before each but an empty one; where a unit has none, a line's end keeps it apart."""
        found = self.library.encode([u[1:] if u[0] == " " else f"\n{u}" for u in units], num_threads=1)
        return [self.space if u == " " else ids if u[0] == " " else ids[len(self.before) :] for ids, u in zip(found, units, strict=True)]


def ranks(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits stand at or before each place, in a packed bitset: popcounts of whole bytes, and of a masked one."""
    sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    byte, bit = places >> 3, places & 7
    return sums[byte] + np.bitwise_count(bits[byte] & ((np.uint16(2) << bit.astype(np.uint16)) - 1).astype(np.uint8))


def marked(ends: np.ndarray, size: int) -> np.ndarray:
    flags = np.zeros(size, dtype=bool)
    flags[ends] = True
    return np.packbits(flags, bitorder="little")


def expanded(group: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, times): the distinct pairs of each group's ids, PAIRS or so at once. Ids are counted before they are paired."""
    ka, na = np.unique(group << 32 | a, return_counts=True)
    kb, nb = np.unique(group_b << 32 | b, return_counts=True)
    ga, gb = ka >> 32, kb >> 32
    lo, hi = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
    upto, at = np.cumsum(hi - lo), 0
    while at < len(ka):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = (hi - lo)[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)
        yield ga[i], (ka[i] & 0xFFFFFFFF) * wide + (kb[j] & 0xFFFFFFFF), na[i] * nb[j]
        at = stop


class Aligner:
    """Alignments of units, remembered by spelling: numbers in arrays, those of a unit's pairs side by side."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.sizes = [np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (self.a, self.b)]
        self.names = [str(i) for i in range(max(map(len, self.sizes)))]
        self.wide = len(self.b.bytes_of)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.figures = [array("q") for _ in FIGURES]
        self.said: list[str] = []
        self.begins, self.pairs, self.times = array("q", [0]), array("q"), array("q")
        self.spoilt: set[int] = set()
        self.held = 0

    def together(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
        """Both sides' ids of all units and how many each unit has, encoded as one text: nothing is joined where units meet, as each
        starts with white space or has a word before it that is left out again. None if the text's tokens don't fit the units."""
        parts, sizes, own = [GUARD], [len(GUARD)], [-1]
        for k, u in enumerate(units):
            if u[-1] in SPACES:
                return None
            if u[0] not in SPACES:
                parts.append(GUARD)
                sizes.append(len(GUARD))
                own.append(-1)
            parts.append(u)
            sizes.append(len(u.encode()))
            own.append(k)
        text, upto, unit = "".join(parts), np.cumsum(sizes), np.array(own)
        raw, all_ids, counts = text.encode(), [], []
        for found, model, length in ((self.a.encode(text), self.a, self.sizes[0]), (self.b.library.encode(text[1:]), self.b, self.sizes[1])):
            ids = np.array(found, dtype=np.int64)
            ends = np.cumsum(length[ids])
            at = np.searchsorted(ends, upto)
            if ends[-1] != len(raw) or (ends[at] != upto).any() or (model is self.b and b"".join(map(model.bytes_of.__getitem__, found)) != raw):
                return None
            of = unit[np.searchsorted(upto, ends)]
            all_ids.append(ids[of >= 0])
            counts.append(np.bincount(of[of >= 0], minlength=len(units)))
        return all_ids, counts

    def apart(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same, unit by unit. A unit that the second model doesn't give back has no ids, and makes its text have none."""
        of_a, of_b = [self.a.encode(u) for u in units], self.b.encode(units)
        for k, unit in enumerate(units):
            if b"".join(map(self.b.bytes_of.__getitem__, of_b[k])) != unit.encode():
                of_a[k], of_b[k] = [], []
                self.spoilt.add(len(self.number) + k)
        return [np.fromiter(itertools.chain.from_iterable(x), dtype=np.int64) for x in (of_a, of_b)], [np.array([*map(len, x)], dtype=np.int64) for x in (of_a, of_b)]

    def add(self, units: list[str]) -> None:
        """Align units, none of them known."""
        ids, counts = self.together(units) or self.apart(units)
        ends = [np.cumsum(length[x]) - 1 for x, length in zip(ids, self.sizes, strict=True)]
        upto_a = np.concatenate([np.zeros(1, dtype=np.int64), ends[0] + 1])
        lengths = np.diff(upto_a[np.cumsum(counts[0])], prepend=0)
        size = int(lengths.sum())
        bits = [marked(e, size) for e in ends]
        cuts = np.flatnonzero(np.unpackbits(bits[0] & bits[1], count=size, bitorder="little")) if size else np.zeros(0, dtype=np.int64)
        upto = [ranks(x, cuts) for x in bits] if size else [np.zeros(0, dtype=np.int64)] * 2
        each = [np.diff(u, prepend=0) for u in upto]  # tokens of each group
        group = [np.repeat(np.arange(len(cuts)), n) for n in each]
        groups_upto = np.searchsorted(cuts, np.cumsum(lengths), "left")
        of_unit = np.repeat(np.arange(len(units)), np.diff(groups_upto, prepend=0))
        names = self.names.__getitem__
        said = [[*map(names, x.tolist())] for x in ids]
        starts = [[0, *u.tolist()] for u in upto]
        texts = [
            f"{said[0][i]}|{said[1][k]}" if j == i + 1 and m == k + 1 else f"{','.join(said[0][i:j])}|{','.join(said[1][k:m])}"
            for i, j, k, m in zip(starts[0], starts[0][1:], starts[1], starts[1][1:], strict=False)
        ]
        links = np.zeros(len(units), dtype=np.int64)
        np.add.at(links, of_unit, each[0] * each[1])
        found = [_summed(of_unit[g], p, n) for g, p, n in expanded(group[0], ids[0], group[1], ids[1], self.wide)]
        u, p, n = _summed(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, dtype=np.int64),) * 3
        known = len(self.number)
        self.number.update(zip(units, range(known, known + len(units)), strict=True))
        for column, values in zip(self.figures, (*(c.tolist() for c in counts), np.diff(groups_upto, prepend=0).tolist(), links.tolist()), strict=True):
            column.extend(values)
        self.begins.extend((len(self.pairs) + np.searchsorted(u, np.arange(1, len(units) + 1))).tolist())
        self.pairs.frombytes(p.tobytes())
        self.times.frombytes(n.tobytes())
        first = [0, *groups_upto.tolist()]
        self.said += [";".join(texts[i:j]) for i, j in zip(first, first[1:], strict=False)]
        self.held += 220 * len(units) + 3 * int(lengths.sum()) + 16 * len(p) + sum(map(len, texts))

    def document(self, text: str) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links), digest of the groups, distinct pairs in order and how often each is linked."""
        if self.held > REMEMBERED:
            self.clear()
        none = ([0, 0, 0, 0], "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        if not text or MARK in text:
            return none
        units = self.b.unit.findall(f" {text}")
        units.pop()  # nothing, at the end
        if new := sorted(set(units).difference(self.number)):
            self.add(new)
        listed = [*map(self.number.__getitem__, units)]
        if self.spoilt and not self.spoilt.isdisjoint(listed):
            return none
        numbers = np.array(listed, dtype=np.int64)
        digest = hashlib.sha256(";".join(map(self.said.__getitem__, listed)).encode()).hexdigest()
        figures = [int(np.frombuffer(f, dtype=np.int64)[numbers].sum()) for f in self.figures]
        begins = np.frombuffer(self.begins, dtype=np.int64)
        low = begins[numbers]
        n = begins[numbers + 1] - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, times = (np.frombuffer(x, dtype=np.int64)[at] for x in (self.pairs, self.times))
        order = np.argsort(pairs, kind="stable")
        pairs, times = pairs[order], times[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        return figures, digest, pairs[first], np.add.reduceat(times, first)


def _summed(unit: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The times of equal (unit, pair) added up, in order of both."""
    order = np.lexsort((pair, unit))
    unit, pair, times = unit[order], pair[order], times[order]
    first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])][: len(unit)])
    return unit[first], pair[first], np.add.reduceat(times, first) if len(first) else times


@functools.cache
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def aligned(df: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """Each row's figures, digest of groups and linked pairs (first id * number of second ids + second id), with the partition and
    place at which it was read."""
    paths = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, row = aligner(*paths), TaskContext.get().partitionId(), 0
        for batch in batches:
            found = [own.document(t) for t in texts_of(batch, "__text")]
            n = len(found)
            figures = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(4)]
            lists = []
            for k in (2, 3):
                offsets = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum([len(f[k]) for f in found], dtype=np.int64)])
                lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([f[k] for f in found]) if n else np.zeros(0, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), batch.column("__id"), *figures, pa.array([f[1] for f in found], pa.string()), *lists], ["part", "row", "doc_id", *FIGURES, "groups_sha256", "pairs", "times"])
            row += n

    return arrow_map(df.select(df[doc_id].cast("long").alias("__id"), df[text].alias("__text")), rows, DOCUMENT)


def hot_class(counts: DataFrame, hot: int = HOT) -> int:
    """The least class of counts (their whole binary logarithm) from which on no more than hot pairs are held. At most 64 rows are read."""
    classes = counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("pairs")).collect()
    total, at = 0, 64
    for r in sorted(classes, key=lambda r: -r.c):
        total += r.pairs
        if total > hot:
            break
        at = r.c
    return at


def align(df: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of df.

    Null and empty texts, and those that the second tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty
    digest. Repeated rows each count as a document and each give a row; an empty table gives none. Texts of any length are aligned
    whole; other columns are left out, whatever their names.
    """
    room = Room(df.sparkSession)
    docs = room.stored(aligned(df, doc_id, text, first, second), "aligned")
    wide = F.lit(sentencepiece.SentencePieceProcessor(model_file=second or public_tokenizers.path(SECOND)).get_piece_size())
    held = docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = room.stored(held, "counts")
    best = counts.groupBy(F.floor(F.col("pair") / wide).alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    judged = counts.join(F.broadcast(best), F.floor(F.col("pair") / wide) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    at = hot_class(counts, hot)
    frequent = F.floor(F.log2("n")) >= at
    links = docs.select("part", "row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("part", "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    head = F.broadcast(judged.where(frequent))  # at most `hot` rows
    met = links.join(head, "pair").unionByName(links.join(head.select("pair"), "pair", "left_anti").join(judged.where(~frequent), "pair"))
    sums = met.groupBy("part", "row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = docs.drop("pairs", "times").join(sums, ["part", "row"], "left")
    return out.select("doc_id", *FIGURES, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
