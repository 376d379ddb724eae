"""Packed rows: segments, targets and masks that never cross a document boundary.

Rows come as arrays of tokens, for which the functions of columns (..._of) are meant: nothing is sorted or shuffled. Tables of
(keys..., pos, token) have functions of their own, by windows over each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import EOD

IGNORED = -100


def row_arrays(tokens: DataFrame, length: int) -> DataFrame:
    """(source_id, row, tokens): each source's documents (tokens, start, end) on end, cut into full rows of so many tokens.

    Documents are cut at row boundaries and travel as arrays; a row is put together from at most length pieces.
    """
    row = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length)))
    touched = tokens.where("end > start").select("source_id", "start", "end", "tokens", row.alias("row"))
    low, high = F.greatest("start", F.col("row") * length), F.least("end", (F.col("row") + 1) * length)
    piece = F.struct(low.alias("at"), F.slice("tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("tokens"))
    rows = touched.select("source_id", "row", piece.alias("piece")).groupBy("source_id", "row").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return rows.select("source_id", "row", F.flatten(F.col("pieces.tokens")).alias("tokens")).where(F.size("tokens") == length)


def packed_rows(tokens: DataFrame, length: int) -> DataFrame:
    """row_arrays as (source_id, row, pos, token), dealt by (source_id, row), so windows over a row need no shuffle of their own."""
    return row_arrays(tokens, length).select("source_id", "row", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once and not for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_of(tokens: Column, eod: int = EOD) -> Column:
    """Where segments begin: at 0 and after each end of document. tokens isn't empty."""
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i == 0) | (F.get(tokens, i - 1) == eod))


def _along(tokens: Column, value: Callable[[Column, Column], Column], eod: int) -> Column:
    """value(start, number) of its segment, for each position."""
    ends = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(tokens))
    return let(starts_of(tokens, eod), lambda starts: F.flatten(F.transform(starts, lambda s, k: F.array_repeat(value(s, k), ends(starts, k) - s))))


def segments_of(tokens: Column, eod: int = EOD) -> Column:
    """The segment of each position, from 1."""
    return _along(tokens, lambda s, k: (k + 1).cast("long"), eod)


def targets_of(tokens: Column, eod: int = EOD) -> Column:
    """The next token, or IGNORED where the token is an end of document, for all positions but the last."""
    return F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), lambda t, i: F.when(t == eod, F.lit(IGNORED)).otherwise(F.get(tokens, i + 1)))


def triples_of(tokens: Column, eod: int = EOD) -> Column:
    """(token, next, target) for predicting two ahead; IGNORED if token or next ends a document."""

    def triple(t: Column, i: Column) -> Column:
        following = F.get(tokens, i + 1)
        return F.struct(t.alias("token"), following.alias("next"), F.when((t == eod) | (following == eod), F.lit(IGNORED)).otherwise(F.get(tokens, i + 2)).alias("target"))

    return F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0))), triple)


def mask_of(tokens: Column, eod: int = EOD) -> Column:
    """(pairs, keys_sum) as mask_sizes has them."""

    def sizes(starts: Column) -> Column:
        def add(a: Column, k: Column) -> Column:
            s = F.get(starts, k).cast("long")
            return let(F.coalesce(F.get(starts, k + 1), F.size(tokens)) - s, lambda n: let(n * (n + 1) / 2, lambda p: F.struct((a["pairs"] + p.cast("long")).alias("pairs"), (a["keys_sum"] + (s * p + (n - 1) * n * (n + 1) / 6).cast("long")).alias("keys_sum"))))

        zero = F.lit(0).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.struct(zero.alias("pairs"), zero.alias("keys_sum")), add)

    return let(starts_of(tokens, eod), sizes)


def lagged_of(values: Column, tokens: Column, weights: list[float], eod: int = EOD) -> Column:
    """Sums over lags of weight times the value so many positions before, 0 across segments, for each position."""

    def summed(begins: Column) -> Column:
        lags = lambda v, i: (F.when(i - lag >= F.get(begins, i), F.get(values, i - lag) * w).otherwise(0.0) for lag, w in enumerate(weights))
        return F.transform(values, lambda v, i: sum(lags(v, i), F.lit(0.0)))

    return let(_along(tokens, lambda s, k: s, eod), summed)


def _row(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("pos")


def with_segments(rows: DataFrame, keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """rows plus is_start (position 0, or after an end of document) and segment (count of starts so far)."""
    started = rows.withColumn("is_start", F.coalesce(F.lag("token").over(_row(keys)) == eod, F.lit(True)))
    return started.withColumn("segment", F.sum(F.col("is_start").cast("long")).over(_row(keys).rowsBetween(Window.unboundedPreceding, 0)))


def cu_seqlens(rows: DataFrame, length: int, keys: tuple[str, ...] = ("source_id", "row")) -> DataFrame:
    """(source_id, offset): flattened offsets of segment starts, and the total at the end, of each source's batch of rows."""
    at = F.col("row") * length + F.col("pos")
    starts = with_segments(rows, keys).where("is_start").select("source_id", at.alias("offset"))
    return starts.union(rows.groupBy("source_id").agg((F.max(at) + 1).alias("offset")))


def with_targets(rows: DataFrame, keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """rows but each one's last, plus target: the next token, or IGNORED where the token is an end of document."""
    following = rows.withColumn("__next", F.lead("token").over(_row(keys))).where("__next is not null")
    return following.withColumn("target", F.when(F.col("token") == eod, F.lit(IGNORED)).otherwise(F.col("__next"))).drop("__next")


def triples(rows: DataFrame, keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """(keys, pos, token, next, target) for predicting two ahead; IGNORED if token or next ends a document."""
    w = _row(keys)
    x = rows.withColumns({"next": F.lead("token", 1).over(w), "after": F.lead("token", 2).over(w)}).where("after is not null")
    return x.select(*keys, "pos", "token", "next", F.when((F.col("token") == eod) | (F.col("next") == eod), F.lit(IGNORED)).otherwise(F.col("after")).alias("target"))


def mask_pairs(rows: DataFrame, keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """(keys, q, k): positions that may attend, in one segment and not ahead. Bounded by a row's length squared."""
    s = with_segments(rows, keys, eod).select(*keys, "segment", "pos")
    q, k = s.withColumnRenamed("pos", "q"), s.withColumnRenamed("pos", "k")
    return q.join(k, [*keys, "segment"]).where("k <= q").select(*keys, "q", "k")


def mask_sizes(rows: DataFrame, keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """(keys, pairs, keys_sum): the number of pairs that mask_pairs lists for each row and the sum of their k, in closed form.

    A segment of n positions from a on has n (n + 1) / 2 pairs, and position a + i is the k of n - i of them.
    """
    s = with_segments(rows, keys, eod).groupBy(*keys, "segment").agg(F.count("*").alias("n"), F.min("pos").alias("a"))
    pairs = F.expr("n * (n + 1) div 2")
    return s.groupBy(*keys).agg(F.sum(pairs).alias("pairs"), F.sum(F.col("a") * pairs + F.expr("(n - 1) * n * (n + 1) div 6")).alias("keys_sum"))


def lagged_sum(rows: DataFrame, value: str, weights: list[float], keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """rows plus lagged: sum over lags of weight times the value so many positions before, 0 across segments."""
    w = _row(keys)
    s = with_segments(rows, keys, eod)
    total = F.lit(0.0)
    for lag, weight in enumerate(weights):
        same = F.col("segment") == F.lag("segment", lag).over(w) if lag else F.lit(True)
        total = total + F.when(same, F.lag(value, lag).over(w) * weight if lag else F.col(value) * weight).otherwise(0.0)
    return s.withColumn("lagged", total).drop("is_start")


def boundaries(rows: DataFrame, keys: tuple[str, ...] = ("source_id", "row"), eod: int = EOD) -> DataFrame:
    """(keys, boundaries): resets inside each row."""
    return with_segments(rows, keys, eod).groupBy(*keys).agg((F.max("segment") - 1).alias("boundaries"))
