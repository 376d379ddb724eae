"""Bounded, repeatable samples of ids for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_ids(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows of df: those whose key has the smallest hash.

    Only rows below a hash that leaves about four times as many are sorted, so no task gathers more than that.
    """
    n = df.count()
    h = F.xxhash64(F.lit(0), F.col(key))
    near = df if n <= 4 * most else df.where(h < F.lit(-(1 << 63) + int((1 << 64) * 4 * most / n)))
    return near.orderBy(h, key).limit(most)


def spread_ids(df: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """At most so many rows of df, or one of each group if there are more groups, spread evenly over the groups: in each those
    whose key has the smallest hash. rank is a row's place in its group. Groups are few and not null.
    """
    counts = df.groupBy(group).count().collect()
    most = max(most, len(counts))
    h = F.xxhash64(F.lit(0), F.col(key))
    ends = [(r[0], (1 << 63) - 1 if r[1] <= 4 * most else -(1 << 63) + int((1 << 64) * 4 * most / r[1])) for r in counts]
    bounds = df.sparkSession.createDataFrame(ends, f"`{group}` {df.schema[group].dataType.simpleString()}, __end long")
    near = df.join(F.broadcast(bounds), group).where(h <= F.col("__end")).drop("__end")  # so no task sorts more than about 4 * most
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(h, key))).where(F.col("rank") <= most)
    return ranked.orderBy("rank", h, key).limit(most)
