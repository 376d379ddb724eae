"""Functions of arrays against the windows over rows of tokens."""

import random

from pyspark.sql import functions as F

from millrace.operators import segments

WEIGHTS = [0.5, 0.25, 0.125]


def test_arrays_give_what_windows_give(spark):
    r = random.Random(2)
    arrays = [[4], [9], [4, 4, 4], [9, 4], *([r.choice((4, 7, 8, 9)) for _ in range(r.randrange(1, 40))] for _ in range(60))]
    packed = spark.createDataFrame([("s", k, a) for k, a in enumerate(arrays)], "source_id string, row long, tokens array<int>")
    rows = packed.select("source_id", "row", F.posexplode("tokens").alias("pos", "token")).withColumn("value", F.col("token").cast("double"))
    t = F.col("tokens")
    got = {
        x.row: x
        for x in packed.select(
            "row", segments.segments_of(t).alias("segments"), segments.starts_of(t).alias("starts"), segments.targets_of(t).alias("targets"), segments.triples_of(t).alias("triples"),
            segments.mask_of(t).alias("mask"), segments.lagged_of(F.transform(t, lambda x: x.cast("double")), t, WEIGHTS).alias("lagged"),
        ).collect()
    }

    def listed(df, *columns):
        out = {k: [] for k in got}
        for x in df.orderBy("row", "pos").collect():
            out[x.row].append(x[columns[0]] if len(columns) == 1 else tuple(x[c] for c in columns))
        return out

    s = segments.with_segments(rows)
    assert listed(s, "segment") == {k: x.segments for k, x in got.items()}
    assert listed(s.where("is_start"), "pos") == {k: x.starts for k, x in got.items()}
    assert listed(segments.with_targets(rows), "target") == {k: x.targets for k, x in got.items()}
    assert listed(segments.triples(rows), "token", "next", "target") == {k: [tuple(y) for y in x.triples] for k, x in got.items()}
    assert listed(segments.lagged_sum(rows, "value", WEIGHTS), "lagged") == {k: x.lagged for k, x in got.items()}
    assert {x.row: (x.pairs, x.keys_sum) for x in segments.mask_sizes(rows).collect()} == {k: tuple(x.mask) for k, x in got.items()}


def test_long_rows_keep_exact_sums(spark):
    packed = spark.createDataFrame([([7] * 300_000,)], "tokens array<int>")
    n = 300_000
    assert tuple(packed.select(segments.mask_of(F.col("tokens"))).first()[0]) == (n * (n + 1) // 2, (n - 1) * n * (n + 1) // 6)
