"""Importance resampling: draw the documents that look most like a target, by hashed n-grams and keyed Gumbel noise.

1. Runs of one and two words are hashed into buckets. Tasks count them in arrays and send sums by bucket; 10,000 numbers of the
   corpus and of the target give each bucket's gain, in thousandths of a logarithm.
2. A document's weight is the floored mean of its features' gains (one look-up in an array for all of them); its score adds noise
   that depends on its id alone. Scores are written before anything is ranked.
3. Counts by score (a weight is a logarithm of a ratio of counts, so there are some 100,000 scores at most) cut the order of the
   draw into ranges of about RANGE rows. A score that more documents have is cut further, by quantiles of their ids.
4. Each task sorts the eligible documents that it has read into runs, cut at the ranges and written as a table. A range's runs are
   then merged by a tournament tree, which stops after the exact number to draw; ranges behind that are never merged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Room, arrow_map, texts_of

#: Production parameters: buckets, percent of the eligible documents that is drawn, words of an eligible document, key of the noise.
BUCKETS, PERCENT, LEAST, KEY = 10_000, 25, 20, 7
#: Rows merged by one task, and rows sorted together by one.
RANGE, RUN = 1 << 17, 1 << 20
#: Bytes of text taken apart at once, bytes of words remembered.
SLICE, REMEMBERED = 1 << 20, 32 << 20
#: Longest word (with the space before it) whose shift has a table.
SHIFTS = 64
POLYNOMIAL = 0xEDB88320
#: Letters A-Z to lower case, what separates words to a space; letters, digits and bytes of other scripts stay.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"
RESULT = ("doc_id", "n_features", "weight", "score")


def _shifts() -> np.ndarray:
    """[n, k, v]: what n zero bytes behind it make of value v in byte k of a CRC. All are linear, so four look-ups shift any CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    out = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    tables = [np.stack(out)]
    for _ in range(SHIFTS):
        tables.append((tables[-1] >> np.uint32(8)) ^ step[tables[-1] & np.uint32(255)])
    return np.stack(tables)


class Features:
    """Buckets of the features of texts. The CRC of two words is that of the first, shifted, against that of the space and the second."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.tables = np.uint32(buckets), _shifts()
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone, self.behind, self.size, self.held = array("I"), array("I"), array("I"), 0

    def words(self, text: str) -> Iterator[list[bytes]]:
        """The words of a text, slice by slice."""
        raw, at = text.encode().translate(LETTERS), 0
        while at < len(raw):
            end = raw.find(b" ", at + SLICE) if at + SLICE < len(raw) else -1
            end = len(raw) if end < 0 else end
            yield raw[at:end].split()
            at = end

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self.held > REMEMBERED:
            self.clear()
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
            self.alone.append(zlib.crc32(w))
            self.behind.append(zlib.crc32(b" " + w))
            self.size.append(len(w) + 1)
            self.held += len(w) + 150
        return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))

    def of(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of their features) of each slice of a text; a pair of words belongs to the slice of its second."""
        last = None
        for words in self.words(text):
            if not words:
                continue
            ids = self.numbers(words)
            alone, behind, size = (np.frombuffer(x, dtype=np.uint32)[ids] for x in (self.alone, self.behind, self.size))
            first = alone[:-1] if last is None else np.concatenate([np.array([last], dtype=np.uint32), alone[:-1]])
            behind, size = behind[len(words) - len(first) :], size[len(words) - len(first) :]
            row = np.minimum(size, SHIFTS)
            pairs = behind.copy()
            for k in range(4):
                pairs ^= self.tables[row, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
            for i in np.flatnonzero(size > SHIFTS):
                pairs[i] = zlib.crc32(b" " + words[i + len(words) - len(first)], int(first[i]))
            last = alone[-1]
            yield len(words), np.concatenate([alone, pairs]) % self.buckets


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Tasks add theirs up; a number for each bucket reaches the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in texts_of(batch, "__text"):
                for _, found in features.of(t):
                    sums += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some])], ["bucket", "n"])

    counted = arrow_map(df.select(df[text].alias("__text")), rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: how much likelier the target has it, a thousand times the logarithm, floored."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, key: int = KEY) -> int:
    h = int(hashlib.sha256(f"{key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(df: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, key: int = KEY) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain))
        for batch in batches:
            ids, out = batch.column("__id").to_pylist(), []
            for d, t in zip(ids, texts_of(batch, "__text"), strict=True):
                words = n = total = 0
                for w, found in features.of(t):
                    words, n, total = words + w, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                out.append((n, weight, weight + noise(d, key), words >= least))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["doc_id", "n_features", "weight", "score", "eligible"])

    return arrow_map(df.select(df[doc_id].cast("long").alias("__id"), df[text].alias("__text")), rows, SCORED)


def cuts_of(eligible: DataFrame, draw: int, by_score: list[tuple[int, int]], size: int) -> list[tuple[int, int | None]]:
    """The first key (score, least id or None for all of that score) of each range from the second on, in the order of the draw.

    by_score: (score, rows), highest first. Scores that no drawn row has aren't cut further.
    """
    counts = np.array([n for _, n in by_score], dtype=np.int64)
    before = np.cumsum(counts) - counts
    drawable = before < draw
    large = {s: -(-n // size) for (s, n), d in zip(by_score, drawable.tolist(), strict=True) if d and n > size}
    inside: dict[int, list[int]] = {}
    if large:
        parts = max(large.values())
        at = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)
        hot = eligible.where(F.col("score").isin(list(large))).groupBy("score").agg(at.alias("at"))
        inside = {r.score: sorted(set(r.at)) for r in hot.collect() if r.at}
    out, held = [], 0
    for (s, n), d in zip(by_score, drawable.tolist(), strict=True):
        if not d:  # nothing from here on can be drawn: a range of its own
            out.append((s, None))
            break
        if held and held + n > size:
            out.append((s, None))
            held = 0
        out += [(s, x) for x in inside.get(s, [])]
        held = size if s in inside else held + n
    return out


class Tournament:
    """A tree of losers over sorted runs: each pop takes the least head and replays one path from leaf to root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.heads = [r[0] if r else None for r in runs]
        self.losers = [-1] * max(k, 1)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        """True if run a's head comes first; an ended run comes last, ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def pop(self) -> tuple[int, int] | None:
        """(run, place) of the next row, or None at the end."""
        won = self.winner
        if not self.runs or self.heads[won] is None:
            return None
        place = self.at[won]
        self.at[won] = place + 1
        self.heads[won] = self.runs[won][place + 1] if place + 1 < len(self.runs[won]) else None
        node, best = (won + len(self.runs)) // 2, won
        while node:
            if self.before(self.losers[node], best):
                best, self.losers[node] = self.losers[node], best
            node //= 2
        self.winner = best
        return won, place


def _sorted_runs(cuts: list[tuple[int, int | None]], run: int):
    low = np.iinfo(np.int64).min
    cut_scores = np.array([s for s, _ in cuts], dtype=np.int64)
    cut_ids = np.array([low if d is None else d for _, d in cuts], dtype=np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run and range: the run's rows in that range, in order."""

        def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            missing = t.column("doc_id").is_null().to_numpy()
            ids, score = t.column("doc_id").fill_null(0).to_numpy(), t.column("score").to_numpy()
            n, k = len(ids), len(cut_ids)
            # a cut stands before all keys from its own on; the number of cuts before a key is its range
            order = np.lexsort((np.r_[np.ones(n), np.zeros(k)], np.r_[ids, cut_ids], np.r_[missing, np.zeros(k, dtype=bool)], -np.r_[score, cut_scores]))
            upto = np.cumsum(order >= n)
            mine = order < n
            ranges, order = upto[mine], order[mine]
            bounds = [*np.flatnonzero(np.diff(ranges, prepend=-1)), n]
            t = t.take(pa.array(order))
            offsets = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, t.column(c).combine_chunks()) for c in RESULT]
            return pa.RecordBatch.from_arrays([pa.array(ranges[bounds[:-1]], pa.int64()), pa.array(np.diff(bounds), pa.int64()), *lists], ["range", "n", *RESULT])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= run:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)

    return rows


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, key: int = KEY, size: int = RANGE, run: int = RUN) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of df; rank is null for those that aren't drawn.

    Drawn are the floor(percent * N / 100) highest scores of the N rows with at least `least` words, ties to the smaller id; a null
    id comes last and has the noise of an empty one, and repeated rows follow one another in any order. Null and empty texts, and
    those without words, have no feature, weight 0 and aren't eligible; an empty table gives no row, with an empty target the
    smoothed counts alone decide. Texts of any length are taken whole, slice by slice; other columns are left out, whatever their names.
    """
    spark, room = df.sparkSession, Room(df.sparkSession)
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets))
    scored = room.stored(scores(df, gain, doc_id, text, least, key), "scores")
    eligible = scored.where("eligible")
    by_score = [(r.score, r.n) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()]
    by_score.sort(reverse=True)
    n = sum(x for _, x in by_score)
    draw = percent * n // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*RESULT, undrawn)
    cuts = cuts_of(eligible, draw, by_score, size)
    runs = room.stored(arrow_map(eligible.select(*RESULT), _sorted_runs(cuts, run), "range long, n long, " + ", ".join(f"{c} array<long>" for c in RESULT)), "runs")
    counts = {r.range: r.n for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    base, before = {}, 0
    for k in sorted(counts):
        if before >= draw:
            break
        base[k] = before
        before += counts[k]
    last = max(base)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Merge a range's runs until the draw is complete; rows after that have no rank."""
        columns = [table.column(c).to_pylist() for c in RESULT]
        keys = [[(-s, d is None, d or 0) for d, s in zip(ids, score, strict=True)] for ids, score in zip(columns[0], columns[3], strict=True)]
        tree, first = Tournament(keys), base[key[0].as_py()]
        out, rest = [], [0] * len(keys)
        while first + len(out) < draw and (found := tree.pop()) is not None:
            out.append(found)
            rest[found[0]] = found[1] + 1
        left = [(r, p) for r, at in enumerate(rest) for p in range(at, len(keys[r]))]
        ranks = [*range(first + 1, first + len(out) + 1), *[None] * len(left)]
        return pa.table([*(pa.array([c[r][p] for r, p in [*out, *left]], pa.int64()) for c in columns), pa.array(ranks, pa.int64())], [*RESULT, "rank"])

    merged = runs.where(F.col("range") <= last).groupBy("range").applyInArrow(merge, ", ".join(f"{c} long" for c in (*RESULT, "rank")))
    rest = ~F.col("eligible")
    if last < len(cuts):
        s, d = cuts[last]
        rest = rest | (F.col("score") < s) | ((F.col("score") == s) & (F.lit(True) if d is None else F.col("doc_id").isNull() | (F.col("doc_id") >= d)))
    return merged.unionByName(scored.where(rest).select(*RESULT, undrawn))
