"""Exact Jaccard similarity join of documents on word shingles, by universe partition and pigeonhole.

Sizes are cut into bands so that a linked pair lies in one band or two that touch; a pair is looked for at the level of its
smaller set. There, two linked sets differ in at most H shingles. The universe of shingles is cut by hash into H + 1 + slack
segments, so a linked pair agrees on whole segments: at least 1 + slack of them.

1. Every segment (a subset of the shingles) is indexed under a hash of its content, at the set's level and the one below.
2. Under each hash the least set is tried against the others, a number of pairs that grows with the sets, not their squares;
   verified links give components. A large group of near copies falls into one component here.
3. Where a hash still joins several components, the pairs across them are tried, if it has at most FEW sets.
4. The rest are crowded hashes. A linked pair agrees on 1 + slack segments, so a set is lost only if its crowded and empty
   segments are more than the slack, and two sets linked by none of the above are both lost and share a crowded hash (or, with
   empty segments only, nothing).
5. Lost sets that crowded hashes bring together are seen by what they differ in from one set, the pivot of their hashes: a shift
   of all sets by one keeps their symmetric differences, and near copies of one text keep next to nothing in common. Each of
   these differences, from the rarest to the most frequent, costs one of the H that a linked pair may have, so both sets hold
   their first common one at places i and j with i + j <= H (or hold H in all and nothing in common). Differences that no
   other set of the pivot has are never looked up: this is the allocation by cost.
6. All tries are verified exactly on the sets of the whole texts.

Sets are compared as sets of 64-bit shingle hashes, and equal sets are one node, known by a 64-bit hash of the set. A second
64-bit hash tells whether two sets share a node; if so, all is hashed anew with another salt.
"""

from __future__ import annotations

import bisect
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Room, arrow_map, texts_of
from .components import components


@dataclass(frozen=True)
class Join:
    """Words in a shingle, similarity as num / den, sets that a hash may try in full, and extra segments per H."""

    shingle: int = 4
    num: int = 85
    den: int = 100
    few: int = 4
    slack_every: int = 16
    slack_least: int = 1


#: Of the query; near copies of the pipeline: five words, 0.8.
STRICT = Join()
NEAR = Join(shingle=5, num=80)
LEVEL_BITS = 8
SEED = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null id where rows are found again by id.
NO_ID = -(1 << 63)
#: Rarest shared differences of a set that are compared before a try, and a key above all others.
HEAD, ALL = 64, (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hashes of recent words; at most 65,536 words of up to 64 bytes, some 10 MB."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = h
        return h


WORDS = _Words()


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; of its whole sequence if it has fewer words; empty for none.

    A-Z count as a-z; words are runs without the six ASCII spaces (bytes methods mean exactly these letters and spaces).
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(ids))
    h = np.full(len(ids) - k + 1, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mixed(h * SEED + ids[i : len(ids) - k + 1 + i])
    return np.unique(h)


class Levels:
    """Bands of set sizes and, for each level, H and the number of segments."""

    def __init__(self, j: Join):
        self.j, self.starts = j, [1]
        while self.starts[-1] < 1 << 40 and len(self.starts) < 1 << LEVEL_BITS:
            at = self.starts[-1]
            self.starts.append(max(at + 1, (at - 1) * j.den // j.num + 1))

    def of(self, size: int) -> list[int]:
        """Levels at which a set of this size is indexed: its band and the one below, if they can hold unequal linked sets."""
        b = bisect.bisect_right(self.starts, size) - 1
        return [x for x in (b, b - 1) if x >= 0 and self.difference(x)]

    def difference(self, level: int) -> int:
        """H: most shingles in which a linked pair, the smaller of this band, can differ."""
        if level + 1 >= len(self.starts):
            raise ValueError("a set is larger than the bands reach")
        small = self.starts[level + 1] - 1
        large = small * self.j.den // self.j.num
        return (small + large) * (self.j.den - self.j.num) // (self.j.den + self.j.num)

    def slack(self, level: int) -> int:
        return self.j.slack_least + self.difference(level) // self.j.slack_every

    def segments(self, level: int) -> int:
        return self.difference(level) + 1 + self.slack(level)


def _code(sums: np.ndarray, segment: np.ndarray, level: int, salt: int = 0) -> np.ndarray:
    """Index hash of segment contents; the level in the lowest bits."""
    h = mixed(sums + mixed(segment.astype(np.uint64) + np.uint64((level << 32) + (salt << 48)) + SEED))
    return ((h & ~np.uint64((1 << LEVEL_BITS) - 1)) | np.uint64(level)).view(np.int64)


def cut(set_: np.ndarray, level: int, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each shingle, the shingles' own hashes, and per segment the sum of these and the number of shingles."""
    m = levels.segments(level)
    segment = (mixed(set_ ^ SEED) % np.uint64(m)).astype(np.int64)
    value = mixed(set_ + SEED)
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, segment, value)
    return segment, value, sums, np.bincount(segment, minlength=m)


def node_of(set_: np.ndarray, salt: int = 0) -> int:
    """The 64-bit hash that stands for a set."""
    with np.errstate(over="ignore"):
        total = mixed(set_ ^ np.uint64(0x5851F42D4C957F2D + salt)).sum(dtype=np.uint64) + np.uint64(len(set_))
        return int(mixed(np.array([total])).view(np.int64)[0])


def indexed(df: DataFrame, j: Join, doc_id: str = "doc_id", text: str = "text", salt: int = 0) -> DataFrame:
    """A row per document: id, place (a hash of its text), n_shingles, node (null for the empty set) and check (a second hash of
    the set), codes of its filled segments, and for each of its levels how many segments it can do without besides its empty
    ones (spare)."""
    chosen = df.select(df[doc_id].cast("long").alias("id"), F.xxhash64(df[text]).alias("place"), df[text].alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, kind = Levels(j), pa.list_(pa.struct([("level", pa.int32()), ("spare", pa.int32())]))
        for batch in batches:
            sizes, nodes, checks, codes, spare = [], [], [], [], []
            for t in texts_of(batch, "__text"):
                s = shingles(t, j.shingle)
                sizes.append(len(s))
                nodes.append(node_of(s, salt) if len(s) else None)
                checks.append(node_of(s, salt + (1 << 32)) if len(s) else None)
                own, left = [], []
                for level in levels.of(len(s)) if len(s) else []:
                    _, _, sums, count = cut(s, level, levels)
                    filled = np.flatnonzero(count)
                    own.append(_code(sums[filled], filled, level))
                    left.append({"level": level, "spare": levels.slack(level) - len(count) + len(filled)})
                codes.append(np.concatenate(own) if own else np.zeros(0, dtype=np.int64))
                spare.append(left)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in codes])]), pa.int32()), pa.array(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), flat, pa.array(spare, kind)], ["id", "place", "n_shingles", "node", "check", "codes", "spare"])

    return arrow_map(chosen, rows, "id long, place long, n_shingles long, node long, check long, codes array<long>, spare array<struct<level:int,spare:int>>")


def _texts(nodes: DataFrame, table: DataFrame, df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text) of one document for each of the nodes, found again by its id and the hash of its text."""
    key = F.struct(F.coalesce(F.col("id"), F.lit(NO_ID)).alias("key"), "place")
    found = table.select("node", key.alias("at")).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("at").alias("at"))
    rows = df.select(F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(df[text]).alias("place"), df[text].alias("text"))
    return found.select("node", "at.*").join(rows, ["key", "place"]).select("node", "text")


def _sets(j: Join, salt: int):
    """A function of (node, text) that gives the set of a text, or None if the text isn't the node's; it keeps recent sets, as
    many as hold about a million shingles."""
    recent: OrderedDict[int, np.ndarray] = OrderedDict()
    held = 0

    def set_of(node: int, text: str) -> np.ndarray | None:
        nonlocal held
        if (s := recent.get(node)) is None:
            s = shingles(text, j.shingle)
            if node_of(s, salt) != node:  # another text under the same id and hash
                return None
            recent[node] = s
            held += len(s)
            while held > 1_000_000:
                held -= len(recent.popitem(last=False)[1])
        return s

    return set_of


def verified(pairs: DataFrame, table: DataFrame, df: DataFrame, j: Join, doc_id: str, text: str, room: Room, salt: int = 0) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by the exact sizes of the sets of their whole texts."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = room.stored(_texts(nodes, table, df, doc_id, text), "texts")
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = _sets(j, salt)
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                p, q = set_of(a, x or ""), set_of(b, y or "")
                if p is not None and q is not None:
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    if j.den * common >= j.num * (len(p) + len(q) - common):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    links = room.stored(arrow_map(whole, rows, "a long, b long").distinct(), "links")
    room.drop(texts)
    return links


def _pivots(crowded: DataFrame) -> DataFrame:
    """(node, level, pivot) of lost sets. crowded: their rows (code, node, level, least).

    The least set of a hash would do as its pivot. To have few pivots for a set, each hash takes the most popular one among
    those of its sets' other hashes.
    """
    codes = crowded.groupBy("code", "level", "least").agg(F.count("*").alias("sets"))  # a pivot has at most as many as segments
    known = codes.groupBy("level", "least").agg(F.sum("sets").alias("n")).join(codes, ["level", "least"]).select("code", F.struct("n", "least").alias("own"))
    rows = crowded.join(known, "code").select("code", "node", "level", "own")
    best = rows.groupBy("node", "level").agg(F.max("own").alias("best"))
    chosen = rows.select("code", "node", "level").join(best, ["node", "level"]).groupBy("code").agg(F.max("best").alias("best"))
    return crowded.select("code", "node", "level").join(chosen, "code").select("node", "level", F.col("best.least").alias("pivot")).distinct()


def _differences(members: DataFrame, table: DataFrame, df: DataFrame, j: Join, doc_id: str, text: str, room: Room, salt: int) -> DataFrame:
    """(part, node, h, shingles): the shingles in which a lost set differs from its pivot (none: the empty set); part stands
    for level and pivot, h for H."""
    nodes = members.select("node").union(members.select("pivot")).where("node is not null").distinct()
    texts = room.stored(_texts(nodes, table, df, doc_id, text), "texts")
    whole = members.join(texts, "node").join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("text_p")), "pivot", "left")
    whole = whole.select(F.xxhash64("level", "pivot").alias("part"), "node", "level", "pivot", "text", "text_p")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of, levels = _sets(j, salt), Levels(j)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for part, node, level, pivot, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "level", "pivot", "text", "text_p")), strict=True):
                own = set_of(node, x or "")
                base = np.zeros(0, dtype=np.uint64) if pivot is None else set_of(pivot, y or "")
                if own is not None and base is not None:
                    for column, value in zip(out, (part, node, levels.difference(level), np.setxor1d(own, base, assume_unique=True).view(np.int64)), strict=True):
                        column.append(value)
            ends = pa.array(np.cumsum([0, *map(len, out[3])]), pa.int32())
            flat = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out[3]) if out[3] else np.zeros(0, dtype=np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), flat], ["part", "node", "h", "shingles"])

    found = room.stored(arrow_map(whole, rows, "part long, node long, h long, shingles array<long>"), "differences")
    room.drop(texts)
    return found


def _near_pivots(differences: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one part and two components that can differ in H shingles at most.

    A difference's key has its number of sets in the highest bits and some of its hash below: the order of keys is by rarity.
    Keys that fall together only lessen the places and the counts of what differs, so no linked pair is lost.
    """
    held = differences.select("part", "node", F.explode("shingles").alias("shingle"))
    counted = held.join(held.groupBy("part", "shingle").agg(F.count("*").alias("n")).where("n > 1"), ["part", "shingle"])
    key = F.shiftleft(F.least("n", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.col("shingle").bitwiseAND(F.lit((1 << 43) - 1)))
    # of one set: at most as many as its shingles and its pivot's
    keys = counted.groupBy("part", "node").agg(F.array_sort(F.collect_set(key)).alias("keys"), F.count("*").alias("n_keys"))
    sets = differences.select("part", "node", "h", F.size("shingles").alias("size")).join(keys, ["part", "node"], "left").withColumns(
        {"keys": F.coalesce("keys", F.array().cast("array<long>")), "lone": F.col("size") - F.coalesce("n_keys", F.lit(0))}
    )
    sets = sets.where("lone <= h").join(comp, "node")
    most = sets.groupBy("part", "comp").agg(F.count("*").alias("n")).groupBy("part").agg(F.max(F.struct("n", "comp")).alias("most"))
    sets = sets.join(most, "part").withColumn("main", F.col("comp") == F.col("most.comp"))
    first = F.slice("keys", 1, F.least(F.lit(HEAD), F.col("h") + 1).cast("int"))
    last = F.when(F.size("first") < F.size("keys"), F.element_at("first", -1)).otherwise(F.lit(ALL))
    sets = sets.withColumn("first", first).withColumn("last", last)
    # a key for sets that may have nothing in common, their differences together being H at most
    alone = F.when(F.col("size") <= F.col("h"), F.array(F.struct(F.col("size").alias("place"), F.lit(ALL).alias("key"))))
    shared = F.transform(F.slice("keys", 1, (F.col("h") + 1 - F.col("lone")).cast("int")), lambda k, i: F.struct((i + F.col("lone")).cast("int").alias("place"), k.alias("key")))
    rows = sets.select("part", "node", "comp", "main", "lone", "h", "first", "last", F.inline(F.concat(shared, F.coalesce(alone, F.array().cast("array<struct<place:int,key:bigint>>")))))
    x, y = rows.where("not main").alias("x"), rows.alias("y")
    common = F.expr("array_intersect(x.first, y.first)")
    differ = F.expr("x.lone + y.lone + size(filter(x.first, k -> k <= y.last)) + size(filter(y.first, k -> k <= x.last))") - 2 * F.size(common)
    meet = (
        (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("y.main") | F.expr("x.node < y.node"))
        & (F.expr("x.place + y.place") <= F.col("x.h")) & ((F.size(common) == 0) | (F.get(common, F.lit(0)) == F.col("x.key"))) & (differ <= F.col("x.h"))
    )
    return x.join(y, meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def node_links(table: DataFrame, df: DataFrame, j: Join, doc_id: str, text: str, room: Room, salt: int = 0) -> DataFrame:
    """Verified links between nodes: not all of them, but enough that their components are those of all links."""
    codes = table.where("node is not null").select("node", F.explode("codes").alias("code"))
    least = room.stored(codes.groupBy("code").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("code", "least"), "least")
    shared = room.stored(codes.join(least, "code").select("code", "node", "least").distinct(), "shared")
    room.drop(least)
    tried = room.stored(shared.where("node != least").groupBy(F.col("least").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n")).select("a", "b"), "tried")
    links = verified(tried, table, df, j, doc_id, text, room, salt)
    comp = room.stored(components(links, room=room), "components")
    own = lambda d: d.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    labelled = room.stored(own(shared), "labelled")
    room.drop(shared)
    open_ = labelled.groupBy("code").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("code", "n")
    open_ = room.stored(labelled.join(open_, "code"), "open")
    room.drop(labelled)
    small = open_.where(F.col("n") <= j.few).select("code", "node", "comp")
    few = small.alias("x").join(small.alias("y"), F.expr("x.code = y.code and x.node < y.node and x.comp != y.comp")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # sets that lose more segments than the slack allows, at the level in the code's lowest bits
    crowded = open_.where(F.col("n") > j.few).select("code", "node", F.col("code").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int").alias("level"), "least")
    spare = table.where("node is not null").select("node", F.inline("spare")).distinct()
    lost = crowded.groupBy("node", "level").agg(F.count("*").alias("n")).join(spare, ["node", "level"]).where("n > spare").select("node", "level")
    members = _pivots(crowded.join(lost, ["node", "level"], "left_semi")).union(spare.where("spare < 0").select("node", "level", F.lit(None).cast("long")))
    differences = _differences(room.stored(members, "members"), table, df, j, doc_id, text, room, salt)
    near = _near_pivots(differences, own(differences.select("node").distinct()))
    tries = room.stored(few.union(near).distinct().join(tried, ["a", "b"], "left_anti"), "tries")
    return links if tries.isEmpty() else room.stored(links.union(verified(tries, table, df, j, doc_id, text, room, salt)), "links")


def _classes(df: DataFrame, j: Join, doc_id: str, text: str, room: Room) -> tuple[DataFrame, DataFrame]:
    """The indexed table without its codes and (node, component) of every node."""
    salt = 0
    while True:
        table = room.stored(indexed(df, j, doc_id, text, salt), "codes")
        nodes = room.stored(table.where("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")), "nodes")
        if nodes.where("lo != hi").isEmpty():
            break
        room.drop(table)
        room.drop(nodes)
        salt += 1
    comp = components(node_links(table, df, j, doc_id, text, room, salt), room=room)
    found = room.stored(nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "classes")
    return table, found


def groups(df: DataFrame, j: Join = STRICT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: doc_id, n_shingles, component_id (the smallest id that links reach, itself included).

    Null, empty and blank texts have no set and link with nothing: component_id is their own id. A row with a null id is in its
    component, but the smallest id is taken over ids that aren't null; if there is none it is null. Repeated rows each give a
    row. An empty table gives an empty result. Texts of any length are read whole. Other columns of df don't matter, whatever
    their names.
    """
    room = Room(df.sparkSession)
    table, comp = _classes(df, j, doc_id, text, room)
    ids = table.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    named = ids.join(comp, "node")
    by_node = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("node", "component_id")
    out = table.select("id", "n_shingles", "node").join(by_node, "node", "left")
    out = room.stored(out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "groups")
    room.clear(out)
    return out


def deduplicated(df: DataFrame, j: Join = NEAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component: that of the smallest id (null ids last). Texts without a set all stay.

    Null, empty and blank texts are texts without a set. Repeated rows are copies of one another: one stays. An empty table
    gives an empty result. All columns of df are kept, whatever their names (but for __millrace_id and __millrace_place).
    """
    room = Room(df.sparkSession)
    table, comp = _classes(df, j, doc_id, text, room)
    at = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id"), "place")
    first = table.where("node is not null").groupBy("node").agg(F.min(at).alias("at")).join(comp, "node").groupBy("component").agg(F.min("at").alias("at"))
    own = ["__millrace_id", "__millrace_place"]
    first = room.stored(first.select(F.col("at.id").alias(own[0]), F.col("at.place").alias(own[1])), "first")
    room.clear(first)
    filled = F.coalesce(df[text], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = df.where(filled).withColumns({own[0]: F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)), own[1]: F.xxhash64(df[text])})
    one = rows.join(first, own, "left_semi").dropDuplicates(own).drop(*own)
    return one.union(df.where(~filled).select(one.columns))
