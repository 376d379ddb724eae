"""Packing: tokens with end-of-document ids, offsets, split and source totals, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# Size of the vocabulary, end of document, first id that isn't special.
VOCABULARY, EOD, FIRST = 49_152, 4, 5
MAJOR_SHARE = 0.01
#: Documents or chunks that are sorted together.
BLOCK = 1 << 16


def hashed_words(text: Column) -> Column:
    """The built-in tokenizer: a word's id is its MD5 folded into the vocabulary. Any Column -> array<int> can stand in for it."""
    words = F.regexp_extract_all(text, F.lit("([^ \\n\\t\\r]+)"), F.lit(1))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int") % (VOCABULARY - FIRST) + FIRST).cast("int"))


def tokenised(df: DataFrame, source: str, seq: str, text: str, tokenizer: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """(source_id, doc_seq, tokens, n_tokens): the tokens of each document that isn't empty, closed by EOD; ids must fit 16 bits."""
    tokens = F.concat(tokenizer(F.col(text)), F.array(F.lit(EOD)))
    rows = df.where((F.col(text) != "") & F.col(text).isNotNull()).select(T.safe_source_id(F.col(source)).alias("source_id"), F.col(seq).alias("doc_seq"), tokens.alias("tokens"))
    ok = F.forall("tokens", lambda t: (t >= 0) & (t <= 65535))
    return rows.withColumn("tokens", F.when(ok, F.col("tokens")).otherwise(F.raise_error(F.lit("a token id doesn't fit 16 bits")))).withColumn("n_tokens", F.size("tokens").cast("long"))


def hashed_lengths(df: DataFrame, source: str, seq: str, text: str) -> DataFrame:
    """(source_id, doc_seq, n_tokens) as tokenised gives them with the built-in tokenizer, without making a token."""
    n = F.regexp_count(F.col(text), F.lit("[^ \\n\\t\\r]+")).cast("long") + 1
    return df.where((F.col(text) != "") & F.col(text).isNotNull()).select(T.safe_source_id(F.col(source)).alias("source_id"), F.col(seq).alias("doc_seq"), n.alias("n_tokens"))


def running(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], block: Column, n: Column, name: str) -> DataFrame:
    """df plus name, the running sum of n within by, in the given order.

    block cuts the order into stretches: a column that never falls along it. Sums of blocks are added up first, a row for each,
    so that no task sorts more than a block however large a group is. Columns of by aren't null.
    """
    keyed = df.withColumn("__block", block)
    sums = keyed.groupBy(*by, "__block").agg(F.sum(n).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(bases, [*by, "__block"]).withColumn(name, F.sum(n).over(inside) + F.col("__base")).drop("__block", "__base")


def blocks_of(number: Column, size: int = BLOCK) -> Column:
    """Stretches of so many whole numbers; nulls, which sort first, are one before all others."""
    return F.coalesce(F.floor(number / size), F.lit(-(1 << 62)))


def offsets(lengths: DataFrame, by: tuple[str, ...] = ("source_id",), order: tuple[str, ...] = ("doc_seq",), n: str = "n_tokens", block: Column | None = None) -> DataFrame:
    """lengths plus start and end of each document in its source, in document order.

    block is needed where the first column of the order isn't a number, see running.
    """
    summed = running(lengths, by, order, blocks_of(F.col(order[0])) if block is None else block, F.col(n), "end")
    return summed.withColumn("start", F.col("end") - F.col(n))


def shard_totals(lengths: DataFrame, split: Column) -> DataFrame:
    """One shard for each split and source: path, tokens, documents."""
    return lengths.groupBy(split.alias("split"), "source_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).withColumn("path", F.concat(F.col("source_id"), F.lit("-"), F.col("split"), F.lit("-00000.bin")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def split_totals(shards: DataFrame) -> DataFrame:
    return shards.groupBy("split").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), F.count("*").alias("shards"))


def source_weights(shards: DataFrame) -> DataFrame:
    """(source_id, tokens, weight, major): share of all tokens; sources of at least MAJOR_SHARE are major."""
    per = shards.groupBy("source_id").agg(F.sum("tokens").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("total"))
    share = F.col("tokens") / F.col("total")
    return per.join(F.broadcast(total), F.lit(True)).select("source_id", "tokens", share.alias("weight"), (share >= MAJOR_SHARE).alias("major"))  # total: one row


def manifest_rows(shards: DataFrame, weights: DataFrame) -> DataFrame:
    """(source_id, weight, major, shards array) as a manifest lists them."""
    lists = shards.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("path", F.regexp_replace("path", r"\.bin$", ".idx").alias("index"), "tokens", "documents"))).alias("shards"))
    return weights.join(lists, "source_id").select("source_id", "weight", "major", "shards")


def violations(sources: DataFrame) -> DataFrame:
    """(source_id, violation) of a source table that can't be interleaved: the checks of an interleaver's constructor."""
    counted = sources.withColumn("__n", F.count("*").over(Window.partitionBy("source_id")))
    w = F.col("weight")
    found = F.filter(
        F.array(
            F.when(F.coalesce(F.col("source_id"), F.lit("")) == "", "empty id"), F.when(F.col("__n") > 1, "id isn't unique"), F.when(F.col("major").isNull(), "major isn't given"),
            F.when(w.isNull() | F.isnan(w) | (w == float("inf")) | (w <= 0), "weight isn't finite and positive"), F.when(F.coalesce(F.col("tokens"), F.lit(0)) <= 0, "no tokens"),
        ),
        lambda v: v.isNotNull(),
    )
    return counted.select("source_id", F.explode(found).alias("violation"))


def fingerprint(sources: DataFrame) -> DataFrame:
    """One SHA-256 of each source's id, weight, major flag and shards, for equality on resume."""
    return sources.select("source_id", F.sha2(F.to_json(F.struct("source_id", "weight", "major", "shards")), 256).alias("fingerprint"))
