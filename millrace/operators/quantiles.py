"""Exact quantiles of groups of any size, by rank selection in repeated histograms.

A first histogram has bins of equal ratios (STEPS to a doubling, signs apart), so any spread of values is cut up alike. Bins know how
many values they hold and the least and the largest of them; the ones in which a wanted rank falls are cut again, into PARTS equal
parts, until all their values are equal. Bins are added up in each task before they are shuffled, so a group is never in one task,
however large it is and however often one value comes.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.folders import shared_folder

STEPS, PARTS = 1024, 1 << 16


def _first_bin(x: Column) -> Column:
    """Bins of equal ratios: a number that never falls as x grows."""
    far = F.floor(F.log2(F.abs(x)) * STEPS) + (1 << 22)
    return F.when(x > 0, far).when(x < 0, -far).otherwise(0)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return functools.reduce(operator.and_, (left[c].eqNullSafe(right[f"__{c}"]) for c in names), F.lit(True))


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in df.columns))


def _stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _found(bins: DataFrame, by: list[str], ranks: Column) -> DataFrame:
    """(by, __lo, __hi, __rank, __wanted): the bin of each wanted rank. bins has by, __bin, __n, __lo, __hi; ranks is an array of
    (rank within what by stands for, which rank of the group that is)."""
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bins.withColumn("__before", before).withColumn("__r", ranks)
    own = F.filter("__r", lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__before") + F.col("__n")))
    hit = placed.withColumn("__r", own).where(F.size("__r") > 0).select(*by, "__before", F.col("__lo").alias("__low"), F.col("__hi").alias("__high"), F.explode("__r").alias("__r"))
    return hit.select(*by, F.col("__low"), F.col("__high"), (F.col("__r.rank") - F.col("__before")).alias("__rank"), F.col("__r.wanted").alias("__wanted"))


def quantiles(df: DataFrame, by: list[str], value: Column, fractions: dict[str, float]) -> DataFrame:
    """by and a column for each fraction: the quantile with linear interpolation, of the values that are finite.

    Groups without such a value have no row. Groups may be null. At most four histograms are made, each a pass over df.
    """
    values = df.select(*by, value.cast("double").alias("__x")).where("__x is not null and not isnan(__x) and abs(__x) < double('infinity')")
    summed = (F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    whole = values.withColumn("__bin", _first_bin(F.col("__x"))).groupBy(*by, "__bin").agg(*summed).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = {name: (F.col("__all") - 1) * F.lit(float(p)) for name, p in fractions.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at.values()))))
    first = _found(whole, by, F.transform(ranks, lambda k: F.struct(k.alias("rank"), k.alias("wanted"))))
    open_ = _stored(first)
    done = open_.where("__low = __high")
    while not (open_ := open_.where("__low < __high")).isEmpty():
        cut = [*by, "__low", "__high"]
        wanted = _renamed(open_.groupBy(*cut).agg(F.collect_list(F.struct(F.col("__rank").alias("rank"), F.col("__wanted").alias("wanted"))).alias("__ranks")), by)  # a few ranks for each group
        met = values.join(wanted, _same(values, wanted, by) & (F.col("__x") >= F.col("__low")) & (F.col("__x") <= F.col("__high")))
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low")) * PARTS))
        bins = met.withColumn("__bin", part).groupBy(*cut, "__ranks", "__bin").agg(*summed)
        narrowed = _found(bins.withColumnRenamed("__low", "__from").withColumnRenamed("__high", "__to"), [*by, "__from", "__to"], F.col("__ranks"))
        open_ = _stored(narrowed.drop("__from", "__to"))
        done = done.unionByName(open_.where("__low = __high"))
    counts = values.groupBy(*by).agg(F.count("*").alias("__all"))
    got = _renamed(done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__wanted", "__low"))).alias("__v")), by)
    joined = counts.join(got, _same(counts, got, by))
    exact = {}
    for name, a in at.items():
        low, high = F.element_at("__v", F.floor(a)), F.element_at("__v", F.ceil(a))
        exact[name] = low + (high - low) * (a - F.floor(a))
    return joined.select(*(counts[c] for c in by), *(q.alias(name) for name, q in exact.items()))
