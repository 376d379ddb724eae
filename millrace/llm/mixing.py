"""Mixing sources to target weights, by DataFrame functions alone.

1. Every source's documents form a stream, ordered by hash, cut into blocks of BLOCK words. A source whose target is above its size
   gives all its blocks once an epoch; the last epoch gives just as many as are still missing, its last block cut to the word.
   So each source has an exact quota of blocks, and its words meet the target.
2. A binary tree splits the quotas among output shards of nearly equal numbers of blocks: what the left half of a node takes of
   each source is one draw of the multivariate hypergeometric distribution, source after source, by inversion of a uniform hash.
   Children get what is left, so quotas stay exact down to the shard.
3. A source's blocks are permuted anew each epoch (their ranks by hash), and the shards take disjoint stretches of that order, as
   long as their quotas. Within a shard the blocks of all sources are shuffled by another hash.

Nothing depends on time, partitions or order of rows: equal tables give equal mixes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.packing import running

from .common import Room

#: Production parameters: weights of the sources in order, most epochs, words in a block, blocks in a shard, seed.
WEIGHTS, MOST, BLOCK, SHARD, SEED = (5, 2, 1), 3, 1024, 1 << 14, 20240607
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source's rows where each meets its source's figures, blocks or documents that are ranked together, levels of the tree made in one task.
SALTS, TOGETHER, LEVELS = 1024, 1 << 16, 6
#: Standard deviations on either side that hold all of a distribution that doubles can tell.
WIDE = 9.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*of: Column) -> Column:
    """A number in [0, 1) that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def place(*of: Column) -> Column:
    """A whole number in [0, 2 ** 63) that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 1)


def stretch(number: Column, rows: int) -> Column:
    """The leading bits of a place: so many that about TOGETHER of the rows share them."""
    return F.shiftright(number, 63 - max(0, math.ceil(math.log2(max(1, rows) / TOGETHER))))


def upto(first: Column, end: Column) -> Column:
    """The whole numbers from first to end, end left out."""
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of the drawn are marked, at quantile u. Weights are relative to the mode's, added up on both sides of it."""
    n, k, d = population, marked, drawn
    low, high = F.greatest(F.lit(0), d + k - n), F.least(d, k)
    share = k / F.greatest(n, F.lit(1))
    deviation = F.sqrt(d * share * (1 - share) * (n - d) / F.greatest(n - 1, F.lit(1)))
    mode = F.least(high, F.greatest(low, F.floor((d + 1).cast("double") * (k + 1) / (n + 2)).cast("long")))
    reach = F.ceil(deviation * WIDE).cast("long") + int(WIDE)

    def ratio(x: Column) -> Column:
        """The weight of x + 1 over that of x."""
        return (k - x).cast("double") * (d - x) / ((x + 1).cast("double") * (n - k - d + x + 1))

    def summed(numbers: Column, factor: Callable[[Column], Column]) -> Column:
        """The last weight and the sum of weights, the mode's left out."""
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        return F.aggregate(numbers, start, lambda a, x: let(a["p"] * factor(x), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum"))))

    def scanned(v: Column, up: Column, down: Column) -> Column:
        limit = u * (1 + up["sum"] + down["sum"])
        start = F.struct(down["p"].alias("p"), down["p"].alias("sum"), v["first"].alias("x"))

        def step(a: Column, x: Column) -> Column:
            on = a["sum"] < limit
            return let(a["p"] * ratio(x), lambda p: F.struct(p.alias("p"), F.when(on, a["sum"] + p).otherwise(a["sum"]).alias("sum"), F.when(on, x + 1).otherwise(a["x"]).alias("x")))

        return F.aggregate(upto(v["first"], v["last"]), start, step, lambda a: a["x"])

    ends = F.struct(mode.alias("mode"), F.greatest(low, mode - reach).alias("first"), F.least(high, mode + reach).alias("last"))
    return let(ends, lambda v: let(F.struct(summed(upto(v["mode"], v["last"]), ratio).alias("up"), summed(F.reverse(upto(v["first"], v["mode"])), lambda x: 1 / ratio(x)).alias("down")), lambda s: scanned(v, s["up"], s["down"])))


def left_half(level: int, seed: int) -> Column:
    """What the left child takes of each source: the first half of the node's blocks, drawn source after source."""
    start = F.struct(F.col("blocks").alias("left"), F.expr("blocks div 2").alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def take(a: Column, q: Column) -> Column:
        x = hypergeometric(a["left"], q, a["draws"], uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(a["out"])))
        return let(x, lambda x: F.struct((a["left"] - q).alias("left"), (a["draws"] - x).alias("draws"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate("quota", start, take, lambda a: a["out"])


def quotas_of_shards(sources: DataFrame, blocks: int, per_shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, n, first, quota): what each shard takes of source n, as a stretch of that source's blocks.

    sources (n, quota): a row for each, in an array that a node of the tree carries.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "quota"))), lambda s: s["quota"])
    nodes = sources.agg(F.lit(0).cast("long").alias("node"), F.sum("quota").alias("blocks"), listed.alias("quota"))
    for level in range(math.ceil(math.log2(max(1, math.ceil(blocks / per_shard))))):
        if level and level % LEVELS == 0:
            nodes = nodes.repartition(F.col("node"))
        halves = nodes.withColumn("left", left_half(level, seed))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.expr("blocks div 2").alias("blocks"), F.col("left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("blocks - blocks div 2").alias("blocks"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")),
        )
        nodes = halves.select(F.explode(children).alias("c")).select("c.*")
    per = nodes.select(F.col("node").alias("shard"), F.posexplode("quota").alias("n", "quota"))
    before = Window.partitionBy("n").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("shard", "n", F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("first"), "quota")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(source, n, source_size, target, goal, blocks, rest, quota) of each source, from (source, source_size).

    n numbers the sources by code point, null last. All sizes are shared out by weight; a target stops at `most` times its
    source's size. In the order of size over weight the stopped ones come first, so the first source that its share of what is
    left doesn't stop settles all behind it. goal is the target in whole words, blocks the blocks of one epoch, rest the words
    of the last, partial epoch, quota all blocks that the mix takes.
    """
    numbered = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("n") % len(weights) + 1)
    by = Window.orderBy(F.col("cap") / F.col("w"), "n")
    ahead = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = numbered.withColumns({"w": w, "cap": F.col("source_size") * most})
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    rest_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0))
    shared = weighed.withColumns({"left": left, "rest_weight": rest_weight, "at": F.row_number().over(by)})
    fits = F.col("left").cast("double") * F.col("w") <= F.col("cap").cast("double") * F.col("rest_weight")
    settled = F.min(F.when(fits, F.struct("at", "left", "rest_weight"))).over(everything)
    out = shared.withColumn("s", settled)
    target = F.when(F.col("at") < F.col("s.at"), F.col("cap").cast("double")).otherwise(F.col("s.left").cast("double") * F.col("w") / F.col("s.rest_weight"))
    out = out.withColumn("target", target).withColumn("goal", F.least(F.round("target").cast("long"), "cap"))
    full = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0)
    out = out.withColumns({"blocks": F.ceil(F.col("source_size") / block), "rest": F.col("goal") - full * F.col("source_size"), "epochs": full})
    return out.select("source", "n", "source_size", "target", "goal", "blocks", "rest", (F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)).alias("quota"))


def drawn_blocks(sources: DataFrame, total: int, per_shard: int = SHARD, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, place, n, epoch, block, words): the blocks of each shard in their shuffled order.

    A source's last block, which is short, comes last in each epoch, so that all others are full.
    """
    epochs = sources.where("quota > 0").select("n", "source_size", "blocks", "rest", "quota", F.explode(upto(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("blocks")))).alias("epoch"))
    spans = epochs.withColumn("span", F.explode(upto(F.lit(0).cast("long"), F.ceil(F.col("blocks") / TOGETHER)))).repartition("n", "epoch", "span")
    each = spans.withColumn("block", F.explode(upto(F.col("span") * TOGETHER, F.least("blocks", (F.col("span") + 1) * TOGETHER))))
    short = F.col("block") == F.col("blocks") - 1
    keyed = each.withColumns({"at": F.when(short, F.lit((1 << 63) - 1)).otherwise(place(F.lit(seed), F.col("n"), F.col("epoch"), F.col("block"))), "one": F.lit(1)})
    ranked = running(keyed, ("n", "epoch"), ("at", "block"), stretch(F.col("at"), total), F.col("one"), "rank")
    d = F.col("epoch") * F.col("blocks") + F.col("rank") - 1
    left = F.col("rest") - F.expr(f"(rest - 1) div {block}") * block
    words = F.when((d == F.col("quota") - 1) & (F.col("rest") > 0), left).when(short, F.col("source_size") - F.col("block") * block).otherwise(F.lit(block))
    permuted = ranked.where(d < F.col("quota")).select("n", d.alias("d"), "epoch", "block", words.cast("long").alias("words"))
    taken = quotas_of_shards(sources.select("n", "quota"), total, per_shard, seed)
    stretches = taken.select("shard", "n", F.explode(upto(F.col("first"), F.col("first") + F.col("quota"))).alias("d"))
    local = Window.partitionBy("shard").orderBy(place(F.lit(seed + 1), F.col("shard"), F.col("n"), F.col("d")), "n", "d")
    return permuted.join(stretches, ["n", "d"]).select("shard", (F.row_number().over(local) - 1).alias("place"), "n", "epoch", "block", "words")


class Mix:
    """A mix of a table: documents (with their source's figures) and pieces.

    Null and empty texts have no words and are never taken; rows without a source are one source. Repeated rows are documents of
    their own. An empty table gives empty results; texts of any length are measured whole; other columns may have any names.
    """

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, per_shard: int = SHARD, seed: int = SEED):
        room = Room(df.sparkSession)
        self.block, self.per_shard, self.seed = block, per_shard, seed
        size = F.coalesce(F.regexp_count(df[text], F.lit(WORD)), F.lit(0)).cast("long")
        sized = room.stored(df.select(df[doc_id].alias("doc_id"), df[source].alias("source"), size.alias("size")), "sizes")
        self.sources = room.stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, block), "sources")
        figures = self.sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total"), F.coalesce(F.max("blocks"), F.lit(0)).alias("most")).first()
        self.total = figures["total"]
        # a source's rows are dealt over SALTS parts, each of which meets a copy of its figures
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        known = self.sources.select(F.col("source").alias("own"), "n", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        met = salted.join(known, F.col("source").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("part")))
        self.documents = room.stored(met.select("doc_id", "source", "size", "n", "source_size", "target"), "documents")
        self.rows = self.documents.count()

    def blocks(self) -> DataFrame:
        return drawn_blocks(self.sources, self.total, self.per_shard, self.block, self.seed)

    def streams(self) -> DataFrame:
        """documents that have words, with start and end in their source's stream."""
        keyed = self.documents.where("size > 0").withColumn("at", place(F.lit(self.seed), F.col("doc_id")))
        placed = running(keyed, ("n",), ("at", "doc_id", "size"), stretch(F.col("at"), self.rows), F.col("size"), "end")
        return placed.withColumn("start", F.col("end") - F.col("size"))

    def pieces(self) -> DataFrame:
        """(shard, place, epoch, block, and of each document in the block: its columns, first and words): words first to first + words
        of the document stand in the block. In order of shard, place and start they are the mixed corpus."""
        touched = self.streams().withColumn("block", F.explode(upto(F.expr(f"start div {self.block}"), F.expr(f"(end - 1) div {self.block} + 1"))))
        low = F.greatest("start", F.col("block") * self.block)
        high = F.least("end", F.col("block") * self.block + F.col("words"))
        met = touched.join(self.blocks(), ["n", "block"])
        return met.where(high > low).select("shard", "place", "epoch", "block", "doc_id", "source", "size", "source_size", "target", "n", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken), a row for each document: how many words of it the mix has."""
        own = ["doc_id", "source", "size", "source_size", "target"]
        nothing = self.streams().select(*own, "n", "start", F.lit(0).cast("long").alias("words"))
        summed = self.pieces().select(*own, "n", "start", "words").unionByName(nothing).groupBy(*own, "n", "start").agg(F.sum("words").alias("taken"))
        return summed.select(*own, "taken").unionByName(self.documents.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken")))
