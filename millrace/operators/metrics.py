"""Run analytics on tables: distributions, validation aggregates, throughput gates, optimiser summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import maths

from .quantiles import quantiles

QUANTILES = {"p01": 0.01, "p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _with(got: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """got with the columns of more for the same groups, null groups too; null where more has none."""
    other = more.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in more.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & got[c].eqNullSafe(other[f"__{c}"])
    return got.join(other, same, "left").drop(*(f"__{c}" for c in by))


def tensor_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: numel, finite_fraction, and over finite values mean, std (population), rms, min, quantiles, max; null if none."""
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    got = df.groupBy(*by).agg(F.count("*").alias("numel"), (F.count(x) / F.count("*")).alias("finite_fraction"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), maths.rms(x).alias("rms"), F.min(x).alias("min"), F.max(x).alias("max"))
    return _with(got, quantiles(df, by, x, QUANTILES), by)


def gate_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """tensor_stats plus the shares of values below 0.01 and above 0.99."""
    v = F.col(value)
    shares = df.groupBy(*by).agg(F.avg((v < 0.01).cast("double")).alias("saturation_low"), F.avg((v > 0.99).cast("double")).alias("saturation_high"))
    return tensor_stats(df, by, value).join(shares, by)


def source_metrics(df: DataFrame, source: str, loss: str, correct: str, margin: str) -> DataFrame:
    """Per source: nll, perplexity, top1_accuracy, correct_token_margin, nll_p10, nll_p90, tokens, of rows with a loss."""
    own = df.where(F.col(loss).isNotNull())
    per = own.groupBy(F.col(source).alias("source")).agg(F.avg(loss).alias("nll"), F.avg(F.col(correct).cast("double")).alias("top1_accuracy"), F.avg(margin).alias("correct_token_margin"), F.count("*").alias("tokens"))
    ends = quantiles(own.withColumnRenamed(source, "source"), ["source"], F.col(loss), {"nll_p10": 0.1, "nll_p90": 0.9})
    return _with(per.withColumn("perplexity", maths.perplexity(F.col("nll"))), ends, ["source"])


def weighted(per: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted means of the per-source metrics (percentiles too); a source without a weight has 1. An error if they sum to 0 or less."""
    w = F.coalesce("weight", F.lit(1.0))
    fields = ("nll", "top1_accuracy", "correct_token_margin", "nll_p10", "nll_p90")
    total = F.when(F.sum("w") > 0, F.sum("w")).otherwise(F.raise_error(F.lit("weights have to add up to a positive number")).cast("double"))
    got = per.join(weights, "source", "left").withColumn("w", w).agg(*((F.sum(F.col("w") * F.col(f)) / total).alias(f) for f in fields), total.alias("weight_sum"), F.sum("tokens").alias("tokens"))
    return got.withColumn("perplexity", maths.perplexity(F.col("nll")))


def lookahead_windows(size: Column, seq: int, budget: Column) -> Column:
    """Windows of seq inputs and one token of look-ahead that a shard of so many tokens gives within a budget of positions."""
    return F.least(F.greatest(F.floor(budget / seq), F.lit(0)), F.greatest(F.floor((size - 1) / seq), F.lit(0)))


def plain_windows(size: Column, seq: int) -> Column:
    """Windows of seq tokens without look-ahead; one that ends exactly with the shard is dropped."""
    return F.when(size > seq, F.floor((size - seq - 1) / seq) + 1).otherwise(F.lit(0))


def source_nll(windows: DataFrame, budget: int, weights: DataFrame | None = None) -> DataFrame:
    """(source, nll, tokens, weight) of windows (shard, window, source, loss_sum, valid), read in that order.

    Reading stops before the first window at which the budget of valid targets is used up over all sources. Weights are those
    declared (an error if one is missing) or the share of tokens. The running sum over all windows is taken per shard first, so
    that no task sees them all.
    """
    per_shard = windows.groupBy("shard").agg(F.sum("valid").alias("n"))
    before = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row per shard
    inside = F.sum("valid").over(Window.partitionBy("shard").orderBy("window")) - F.col("valid")
    used = windows.withColumn("inside", inside).join(before, "shard").where(F.col("inside") + F.col("before") < budget)
    per = used.groupBy("source").agg((F.sum("loss_sum") / F.sum("valid")).alias("nll"), F.sum("valid").alias("tokens"))
    if weights is None:
        return per.withColumn("weight", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)))  # a row per source
    declared = weights.select("source", F.col("weight").cast("double").alias("weight"))
    return per.join(declared, "source", "left").withColumn("weight", F.coalesce("weight", F.raise_error(F.concat(F.lit("no weight for "), "source")).cast("double")))


def validation_nll(windows: DataFrame, budget: int, weights: DataFrame | None = None) -> DataFrame:
    """One row: weighted_nll, validation_tokens, sources, of source_nll's rows. Without windows weighted_nll is null."""
    w = F.col("weight")
    return source_nll(windows, budget, weights).agg((F.sum(w * F.col("nll")) / F.greatest(F.sum(w), F.lit(maths.FLOOR))).alias("weighted_nll"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("validation_tokens"), F.count("*").alias("sources"))


def steady_throughput(log: DataFrame, run: str, order: list[str], rate: str, peak: str, limit: float) -> DataFrame:
    """Per run, over all records but the first: median and mean rate; over all: peak, limit gate, all_finite."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    steady = F.when(F.col("__n") > 1, F.col(rate))
    numbered = log.withColumn("__n", n)
    got = _with(numbered.groupBy(run).agg(F.avg(steady).alias("steady_mean"), F.max(peak).alias("peak"), F.bool_and(finite(F.col(rate))).alias("all_finite"), F.count("*").alias("steps")), quantiles(numbered, [run], steady, {"steady_median": 0.5}), [run])
    return got.withColumns({"headroom": F.lit(limit) - F.col("peak"), "within_limit": F.col("peak") <= limit})


def optimizer_summary(df: DataFrame, name: str = "name", tensor: str = "tensor_id", value: str = "value") -> DataFrame:
    """Per state name: tensor_count, numel, finite_fraction, rms and max_abs over finite values (0 if none)."""
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    return df.groupBy(name).agg(
        F.countDistinct(tensor).alias("tensor_count"), F.count("*").alias("numel"), (F.count(x) / F.greatest(F.count("*"), F.lit(1))).alias("finite_fraction"),
        F.sqrt(F.coalesce(F.sum(x * x), F.lit(0.0)) / F.greatest(F.count(x), F.lit(1))).alias("rms"), F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("max_abs"),
    )


def route_stats(df: DataFrame, by: list[str], weight: str, added: str, residual: str) -> DataFrame:
    """Per group of routing weights: sources, entropy, largest weight, RMS of what is added and of the residual, their ratio."""
    p = F.col(weight).cast("double")
    got = df.groupBy(*by).agg(F.count("*").alias("source_count"), (-F.sum(p * F.ln(F.greatest(p, F.lit(maths.FLOOR))))).alias("entropy"), F.max(p).alias("max_weight"), maths.rms(F.col(added)).alias("added_rms"), maths.rms(F.col(residual)).alias("residual_rms"))
    return got.withColumn("ratio", F.col("added_rms") / F.greatest("residual_rms", F.lit(maths.FLOOR)))


def totals_by_prefix(df: DataFrame, name: str, size: str, prefixes: list[str]) -> DataFrame:
    """One row: the sum of size for each prefix of name, and of all."""
    return df.agg(*(F.sum(F.when(F.col(name).startswith(p), F.col(size)).otherwise(0)).alias(p.rstrip(".")) for p in prefixes), F.sum(size).alias("total"))
