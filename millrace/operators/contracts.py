"""Contracts between runs: equality of settings, complete arms, winners, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCREEN_TOKENS = 67_108_864
EXEMPT = "step_00000000"


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, left_value, right_value) where two tables of settings differ, nulls being equal to each other and to missing."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def latest(df: DataFrame, by: str, name: str) -> DataFrame:
    """Each group's row of the last name in string order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(name)))).where("__n = 1").drop("__n")


def arm_faults(arms: DataFrame) -> DataFrame:
    """arms (status, scope, tokens_done, validation_tokens_done, weighted_nll) plus fault, null for a complete arm."""
    fault = (
        F.when(~F.col("status").eqNullSafe(F.lit("complete")), "incomplete")
        .when(~F.col("scope").eqNullSafe(F.lit("full")), "no full validation")
        .when(~F.col("tokens_done").eqNullSafe(F.col("validation_tokens_done")), "token mismatch")
        .when(F.col("weighted_nll").isNull(), "no weighted nll")
    )
    return arms.withColumn("fault", fault)


def screen(baseline: DataFrame, other: DataFrame, keys: list[str], names: tuple[str, str], least: int = SCREEN_TOKENS) -> DataFrame:
    """Pairs of arms: winner is the name of the lower weighted_nll, 'inconclusive' for equal ones, null with a fault."""
    a, b = (x.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("fault", "tokens_done", "weighted_nll"))) for p, x in (("a", arm_faults(baseline)), ("b", arm_faults(other))))
    fault = F.coalesce(F.col("a_fault"), F.col("b_fault"), F.when(F.col("a_tokens_done") != F.col("b_tokens_done"), F.lit("token budgets differ")), F.when(F.col("a_tokens_done") < least, F.lit("too few tokens")))
    winner = F.when(F.col("a_weighted_nll") == F.col("b_weighted_nll"), "inconclusive").when(F.col("b_weighted_nll") < F.col("a_weighted_nll"), names[1]).otherwise(names[0])
    return a.join(b, keys).withColumn("fault", fault).select(*keys, F.col("a_tokens_done").alias("tokens_per_arm"), F.when(F.col("fault").isNull(), winner).alias("winner"), "fault")


def retained(df: DataFrame, by: str, name: str, keep: int = 2) -> DataFrame:
    """The newest names of each group, and the exempt first step."""
    n = F.row_number().over(Window.partitionBy(by).orderBy((F.col(name) == EXEMPT).cast("int"), F.desc(name)))
    return df.withColumn("__n", n).where((F.col("__n") <= keep) | (F.col(name) == EXEMPT)).drop("__n")


def recent(df: DataFrame, by: str, order: list[str], n: int = 100) -> DataFrame:
    """The last n records of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)))).where(F.col("__n") <= n).drop("__n")


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are expected and not there."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def controlled_stops(steps: DataFrame, by: str, step: str, loss: str, tokens: str, keep: int = 100) -> DataFrame:
    """Runs whose loss stops being finite, rolled back to the step before: what holds of the committed steps alone.

    (by, status, step, tokens_done, resumable_checkpoint, recent_successful_steps): the last committed step (0 if there is none),
    its tokens so far, the name of the diagnostic checkpoint, and the last keep committed steps. A null loss isn't finite; runs
    without such a step have no row.
    """
    value = F.col(loss)
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
    bad = steps.where(~finite).groupBy(by).agg(F.min(step).alias("__bad"))
    good = steps.join(bad, by).where(F.col(step) < F.col("__bad"))
    done = good.groupBy(by).agg(F.max(step).alias("step"), F.sum(tokens).alias("tokens_done"))
    last = recent(good.select(by, step), by, [step], keep).groupBy(by).agg(F.sort_array(F.collect_list(step)).alias("recent"))
    at = F.coalesce("step", F.lit(0)).cast("long")
    name = F.concat(F.lit("step_"), F.when(F.length(at.cast("string")) < 8, F.lpad(at.cast("string"), 8, "0")).otherwise(at.cast("string")), F.lit("_diagnostic"))
    none = F.array().cast("array<long>")
    return bad.join(done, by, "left").join(last, by, "left").select(by, F.lit("controlled_nonfinite_stop").alias("status"), at.alias("step"), F.coalesce("tokens_done", F.lit(0)).cast("long").alias("tokens_done"), name.alias("resumable_checkpoint"), F.coalesce(F.col("recent").cast("array<long>"), none).alias("recent_successful_steps"))
