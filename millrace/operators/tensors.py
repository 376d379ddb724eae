"""Statistics of tensors that come as buffers: a row holds an array or the raw bytes of many values, and no row per value is made.

Tasks reduce each batch to moments of its groups (count, mean, squared deviations, least and largest), which are merged exactly
whatever the batches were. Quantiles are found in the order of the values' bits, sixteen bits at a time: tasks count the next bits
of values that share a wanted prefix, and the prefix in which a rank falls grows until it is a value.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import QUANTILES
from .quantiles import _stored

#: Kinds of raw values (little-endian), and the bits of a value. Arrays of doubles have 64.
KINDS = {"float16": 32, "bfloat16": 32, "float32": 32, "float64": 64}


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of the rows on end, as 32- or 64-bit floats, and how many each row has. Null elements count as NaN."""
    wide = np.float64 if KINDS[kind] == 64 else np.float32
    if pa.types.is_list(column.type):
        sizes = np.asarray(column.value_lengths().fill_null(0))
        return column.flatten().to_numpy(zero_copy_only=False).astype(wide), sizes
    raw = [b or b"" for b in column.to_pylist()]
    joined = b"".join(raw)
    if kind == "bfloat16":
        flat = (np.frombuffer(joined, "<u2").astype("<u4") << 16).view("<f4")
    else:
        flat = np.frombuffer(joined, {"float16": "<f2", "float32": "<f4", "float64": "<f8"}[kind]).astype(wide)
    return flat, np.array([len(b) for b in raw], dtype=np.int64) // (2 if kind.endswith("16") else KINDS[kind] // 8)


def _groups(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, list[int]]:
    """The group of each row, and the first row of each group."""
    seen: dict[tuple, int] = {}
    first: list[int] = []
    number = np.empty(batch.num_rows, dtype=np.int64)
    for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else [()] * batch.num_rows):
        if key not in seen:
            seen[key] = len(first)
            first.append(k)
        number[k] = seen[key]
    return number, first


def _ordered(x: np.ndarray) -> np.ndarray:
    """Bits of floats as unsigned numbers in the order of the floats; both zeros are one."""
    whole, signed = (np.uint64, np.int64) if x.dtype == np.float64 else (np.uint32, np.int32)
    bits = (x + x.dtype.type(0)).view(signed)  # -0.0 + 0 is 0
    top = whole(1 << (8 * x.itemsize - 1))
    return np.where(bits < 0, ~bits.view(whole), bits.view(whole) | top).astype(np.uint64)


def _floats(bits: np.ndarray, wide: int) -> np.ndarray:
    whole, real = (np.uint64, np.float64) if wide == 64 else (np.uint32, np.float32)
    b, top = bits.astype(whole), whole(1 << (wide - 1))
    return np.where(b & top, b ^ top, ~b).astype(whole).view(real).astype(np.float64)


def moments(df: DataFrame, by: list[str], buffer: str, kind: str = "float32") -> DataFrame:
    """by, numel, finite_fraction, and over finite values mean, std (population), rms, min, max; null if there are none."""
    names = ["n", "finite", "mean", "m2", "min", "max"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, first = _groups(batch, by)
            flat, sizes = _values(batch.column("__buffer"), kind)
            of = np.repeat(group, sizes)
            k = len(first)
            n = np.bincount(of, minlength=k)
            good = np.isfinite(flat)
            x, of = flat[good].astype(np.float64), of[good]
            finite = np.bincount(of, minlength=k)
            mean = np.bincount(of, x, minlength=k) / np.maximum(finite, 1)
            mean += np.bincount(of, x - mean[of], minlength=k) / np.maximum(finite, 1)
            m2 = np.bincount(of, (x - mean[of]) ** 2, minlength=k)
            low, high = np.full(k, np.inf), np.full(k, -np.inf)
            np.minimum.at(low, of, x)
            np.maximum.at(high, of, x)
            some = pa.array(finite == 0)
            columns = [pa.array(n), pa.array(finite), *(pa.compute.if_else(some, pa.scalar(None, pa.float64()), pa.array(v)) for v in (mean, m2, low, high))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in by), *columns], [*by, *names])

    chosen = df.select(*by, F.col(buffer).alias("__buffer"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "n long, finite long, mean double, m2 double, min double, max double"])
    parts = chosen.mapInArrow(rows, schema)
    all_ = Window.partitionBy(*by)
    at = parts.withColumn("all", F.sum(F.col("mean") * F.col("finite")).over(all_) / F.sum("finite").over(all_))  # a row per batch and group
    spread = F.sum(F.col("m2") + F.col("finite") * (F.col("mean") - F.col("all")) ** 2)
    n = F.sum("finite")
    out = at.groupBy(*by).agg(F.sum("n").alias("numel"), n.alias("f"), F.max("all").alias("mean"), spread.alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))
    return out.select(*by, "numel", (F.col("f") / F.col("numel")).alias("finite_fraction"), "mean", F.sqrt(F.col("m2") / F.col("f")).alias("std"), F.sqrt(F.col("m2") / F.col("f") + F.col("mean") ** 2).alias("rms"), "min", "max")


def buffer_quantiles(df: DataFrame, by: list[str], buffer: str, kind: str = "float32", fractions: dict[str, float] = QUANTILES) -> DataFrame:
    """by and a column for each fraction: quantiles with linear interpolation of the finite values. Groups without any have no row."""
    wide = KINDS[kind]
    chosen = df.select(*by, F.col(buffer).alias("__buffer"))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]

    def counted(given: DataFrame, shift: int, all_: bool) -> DataFrame:
        """(by, prefix, bin, n): the next sixteen bits of values under each row's wanted prefixes."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, first = _groups(batch, by)
                flat, sizes = _values(batch.column("__buffer"), kind)
                of, good = np.repeat(group, sizes), np.isfinite(flat)
                bits, of = _ordered(flat[good]), of[good]
                prefix = (bits >> np.uint64(shift + 16)).astype(np.int64) if shift + 16 < wide else np.zeros(len(bits), dtype=np.int64)
                if not all_:
                    wanted = [set(batch.column("__prefixes")[k].as_py()) for k in first]
                    inside = np.zeros(len(bits), dtype=bool)
                    for g, own in enumerate(wanted):
                        inside |= (of == g) & np.isin(prefix, list(own))
                    bits, of, prefix = bits[inside], of[inside], prefix[inside]
                part = ((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                order = np.lexsort((part, prefix, of))
                cols = [c[order] for c in (of, prefix, part)]
                new = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in cols], axis=0)) if len(order) else np.zeros(0, dtype=np.int64)
                n = np.diff([*new, len(order)])
                own = pa.array(np.array(first, dtype=np.int64)[cols[0][new]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in by), pa.array(cols[1][new]), pa.array(cols[2][new]), pa.array(n.astype(np.int64))], [*by, "__prefix", "__bin", "__n"])

        found = given.mapInArrow(rows, ", ".join([*keys, "__prefix long, __bin long, __n long"]))
        return found.groupBy(*by, "__prefix", "__bin").agg(F.sum("__n").alias("__n"))

    def narrowed(bins: DataFrame, ranks: F.Column) -> DataFrame:
        """(by, __prefix, __rank, __wanted) of the longer prefixes in which the ranks fall."""
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by, "__prefix").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = bins.withColumn("__before", before).withColumn("__r", ranks)
        own = F.filter("__r", lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__before") + F.col("__n")))
        hit = placed.withColumn("__r", F.explode(own))
        return hit.select(*by, F.shiftleft("__prefix", 16).bitwiseOR(F.col("__bin")).alias("__prefix"), (F.col("__r.rank") - F.col("__before")).alias("__rank"), F.col("__r.wanted").alias("__wanted"))

    bins = counted(chosen, wide - 16, True).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = {name: (F.col("__all") - 1) * F.lit(float(p)) for name, p in fractions.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at.values()))))
    counts = _stored(bins.groupBy(*by).agg(F.max("__all").alias("__all")))
    found = _stored(narrowed(bins, F.transform(ranks, lambda k: F.struct(k.alias("rank"), k.alias("wanted")))))

    def renamed(table: DataFrame, *names: str) -> DataFrame:
        return table.select(*(F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in table.columns))

    def same(left: DataFrame, right: DataFrame, names: list[str]) -> F.Column:
        return functools.reduce(operator.and_, (left[c].eqNullSafe(right[f"__{c}"]) for c in names), F.lit(True))

    for shift in range(wide - 32, -1, -16):
        groups = renamed(found.groupBy(*by).agg(F.collect_set("__prefix").alias("__prefixes")), *by)  # a few prefixes for each group
        given = chosen.join(groups, same(chosen, groups, by)).select(*(chosen[c] for c in by), "__buffer", "__prefixes")
        wanted = renamed(found.groupBy(*by, "__prefix").agg(F.collect_list(F.struct(F.col("__rank").alias("rank"), F.col("__wanted").alias("wanted"))).alias("__ranks")), *by, "__prefix")
        bins = counted(given, shift, False)
        met = bins.join(wanted, same(bins, wanted, [*by, "__prefix"])).select(*(bins[c] for c in by), bins["__prefix"], "__bin", "__n", "__ranks")
        found = _stored(narrowed(met, F.col("__ranks")))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column("__prefix")).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("__wanted"), pa.array(_floats(bits, wide))], [*by, "__wanted", "__x"])

    exact = found.mapInArrow(back, ", ".join([*keys, "__wanted long, __x double"]))
    got = renamed(exact.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__wanted", "__x"))).alias("__v")), *by)
    joined = counts.join(got, same(counts, got, by))
    out = {}
    for name, a in at.items():
        low, high = F.element_at("__v", F.floor(a)), F.element_at("__v", F.ceil(a))
        out[name] = low + (high - low) * (a - F.floor(a))
    return joined.select(*(counts[c] for c in by), *(q.alias(name) for name, q in out.items()))
