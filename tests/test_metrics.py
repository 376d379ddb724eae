import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import maths
from millrace.operators import contracts, metrics, quantiles


def test_tensor_stats_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, float("nan"), float("inf"))] + [("b", float("nan"))], "g string, v double")
    got = {r.g: r for r in metrics.tensor_stats(df, ["g"], "v").collect()}
    assert (got["a"].numel, got["a"].finite_fraction, got["a"].mean, got["a"].median) == (5, 0.6, 2.0, 2.0)
    assert got["b"].numel == 1 and got["b"].finite_fraction == 0.0 and got["b"].mean is None


def test_optimizer_summary(spark):
    df = spark.createDataFrame([("m", 0, 3.0), ("m", 0, 4.0), ("m", 1, 0.0), ("m", 1, 0.0)], "name string, tensor_id long, value double")
    r = metrics.optimizer_summary(df).first()
    assert (r.tensor_count, r.numel, r.rms, r.max_abs) == (2, 4, 2.5, 4.0)


def test_weighted_validation(spark):
    per = spark.createDataFrame([("x", 2.0, 0.5, 1.0, 1.0, 3.0, 10), ("y", 4.0, 0.1, 0.0, 2.0, 5.0, 30)], "source string, nll double, top1_accuracy double, correct_token_margin double, nll_p10 double, nll_p90 double, tokens long")
    r = metrics.weighted(per, spark.createDataFrame([("x", 3.0)], "source string, weight double")).first()
    assert (r.nll, r.weight_sum, r.tokens) == (2.5, 4.0, 40) and math.isclose(r.perplexity, math.exp(2.5))
    with pytest.raises(Exception, match="positive"):
        metrics.weighted(per, spark.createDataFrame([("x", 0.0), ("y", 0.0)], "source string, weight double")).collect()


def test_validation_budget_stops_in_shard_order(spark):
    w = spark.createDataFrame([(0, 0, "a", 10.0, 5), (0, 1, "a", 20.0, 5), (1, 0, "b", 5.0, 5)], "shard long, window long, source string, loss_sum double, valid long")
    assert metrics.validation_nll(w, 8).first()[:] == (3.0, 10, 1)
    assert metrics.validation_nll(w, 11).first().sources == 2
    assert metrics.validation_nll(w.limit(0), 8).first()[:] == (None, 0, 0)
    with pytest.raises(Exception, match="no weight for"):
        metrics.validation_nll(w, 100, spark.createDataFrame([("a", 1.0)], "source string, weight double")).collect()
    sizes = spark.createDataFrame([(9,), (8,), (4,), (0,)], "n long")
    got = sizes.select(metrics.lookahead_windows(F.col("n"), 4, F.lit(100)), metrics.plain_windows(F.col("n"), 4)).collect()
    assert [tuple(r) for r in got] == [(2, 2), (1, 1), (0, 0), (0, 0)]


def test_schedule_and_steps(spark):
    lr = {r.s: r.x for r in spark.range(0, 40).select(F.col("id").alias("s"), maths.learning_rate(F.col("id"), 10, 30, 1.0, 0.1).alias("x")).collect()}
    assert lr[0] == 0.1 and lr[9] == 1.0 and lr[10] == 1.0 and math.isclose(lr[30], 0.1) and lr[39] == lr[30] and math.isclose(lr[20], 0.55)
    assert spark.range(1).select(maths.target_step(F.lit(16_000_000_000), F.lit(65_536))).first()[0] == 244_141


def arm(status="complete", scope="full", tokens=70_000_000, validated=None, nll=2.0):
    return (0, status, scope, tokens, tokens if validated is None else validated, nll)


@pytest.mark.parametrize(
    "a, b, want",
    [(arm(), arm(nll=1.5), ("routed", None)), (arm(), arm(), ("inconclusive", None)), (arm(nll=1.0), arm(), ("normal", None)), (arm(status="failed"), arm(), (None, "incomplete")), (arm(), arm(scope="part"), (None, "no full validation")), (arm(validated=1), arm(), (None, "token mismatch")), (arm(tokens=5), arm(tokens=5), (None, "too few tokens")), (arm(), arm(tokens=80_000_000), (None, "token budgets differ")), (arm(nll=None), arm(), (None, "no weighted nll"))],
)
def test_screen(spark, a, b, want):
    schema = "k long, status string, scope string, tokens_done long, validation_tokens_done long, weighted_nll double"
    r = contracts.screen(spark.createDataFrame([a], schema), spark.createDataFrame([b], schema), ["k"], ("normal", "routed")).first()
    assert (r.winner, r.fault) == want


def test_mismatches_and_retention(spark):
    left, right = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "1"), ("b", None), ("c", "2")], [("a", "1"), ("c", "3"), ("d", "4")]))
    assert sorted(r.k for r in contracts.mismatches(left, right, ["k"], "v").collect()) == ["c", "d"]
    names = spark.createDataFrame([("r", f"step_{n:08d}") for n in (0, 5, 10, 15)], "run string, name string")
    assert sorted(r.name[-2:] for r in contracts.retained(names, "run", "name").collect()) == ["00", "10", "15"]


VALUES = {
    "ties": [0.0] * 300 + [1.0] * 200 + [-1.0] * 50, "one": [7.5], "two": [1.0, 2.0], "spread": [10.0**k * s for k in range(-300, 301, 7) for s in (1, -1)], "tiny": [5e-324 * k for k in range(40)] + [-5e-324],
    "close": [1.0 + k * 2.0**-52 for k in range(1000)], "odd": [float("nan"), float("inf"), float("-inf"), None, 3.0, 4.0], "none": [None, float("nan")], None: [1.5, 2.5, 9.0],
}


def test_quantiles_are_numpy_s(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = VALUES | {"normal": rng.normal(0, 1, 3000).tolist(), "heavy": rng.standard_cauchy(3000).tolist()}
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "g string, v double").repartition(5)
    for parts in (1 << 16, 4):
        monkeypatch.setattr(quantiles, "PARTS", parts)
        got = {r.g: [r[n] for n in metrics.QUANTILES] for r in quantiles.quantiles(df, ["g"], F.col("v"), metrics.QUANTILES).collect()}
        assert set(got) == set(values) - {"none"}
        for g, found in got.items():
            own = [x for x in values[g] if x is not None and math.isfinite(x)]
            assert found == pytest.approx(np.quantile(own, list(metrics.QUANTILES.values())).tolist(), rel=1e-14, abs=0), g
    assert quantiles.quantiles(df.limit(0), ["g"], F.col("v"), {"median": 0.5}).count() == 0
    whole = quantiles.quantiles(df, [], F.col("v"), {"median": 0.5}).first()
    assert whole.median == np.median([x for xs in values.values() for x in xs if x is not None and math.isfinite(x)])


def test_no_task_takes_a_whole_group(spark):
    """Before every exchange the values are added up by bin, so what is dealt by group is bins, a few thousand however many values."""
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.sin("id").alias("v"))
    bins = df.withColumn("b", quantiles._first_bin(F.col("v"))).groupBy("g", "b").count()
    plan = bins._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and bins.count() < 50_000
    got = quantiles.quantiles(df, ["g"], F.col("v"), {"p": 0.3}).first()
    assert got.p == pytest.approx(np.quantile(np.sin(np.arange(200_000.0)), 0.3), abs=1e-12)
