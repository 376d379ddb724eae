"""Scalar arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-30


def learning_rate(step: Column, warmup: int, schedule: int, peak: float, least: float) -> Column:
    """Linear warm-up over the first steps, then a cosine from peak to least; flat after the schedule ends."""
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, schedule - warmup)))))
    return F.when(step < warmup, peak * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(least + 0.5 * (peak - least) * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def schedule_steps(tokens: int, tokens_per_step: int) -> int:
    return tokens // tokens_per_step


def target_step(tokens: Column, per_step: Column) -> Column:
    """Steps that reach so many tokens (ceiling division); an error unless both are positive."""
    return F.when((tokens > 0) & (per_step > 0), ((tokens + per_step - 1 - F.pmod(tokens + per_step - 1, per_step)) / per_step).cast("long")).otherwise(F.raise_error(F.lit("tokens and tokens per step must be positive")))


def perplexity(nll: Column) -> Column:
    return F.exp(F.least(nll, F.lit(20.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.lit(FLOOR))


def rms(x: Column) -> Column:
    """Aggregate: root mean square."""
    return F.sqrt(F.avg(x * x))


def variation(x: Column) -> Column:
    """Aggregate: population standard deviation over the mean."""
    return F.stddev_pop(x) / F.greatest(F.avg(x), F.lit(FLOOR))


def entropy(weights: Column) -> Column:
    """Of an array of weights that sum to one."""
    return -F.aggregate(weights, F.lit(0.0), lambda s, p: s + p.cast("double") * F.ln(F.greatest(p.cast("double"), F.lit(FLOOR))))


def gate(x: Column) -> Column:
    """4 tanh(x / 4) sigmoid(x)"""
    return 4 * F.tanh(x / 4) / (1 + F.exp(-x))


def softcap(x: Column, cap: float = 25.0) -> Column:
    return cap * F.tanh(x / cap)
