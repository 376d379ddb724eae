"""Buffers of values against NumPy."""

import math

import numpy as np
import pytest

from millrace.operators import tensors
from millrace.operators.metrics import QUANTILES

RNG = np.random.default_rng(8)
GROUPS = {
    "normal": [RNG.normal(0, 1, n) for n in (700, 1, 0, 300)], "far": [RNG.normal(1e6, 1e-2, 500) for _ in range(3)], "ties": [np.zeros(400), -np.zeros(3), np.ones(10)], "odd": [np.array([np.nan, np.inf, -np.inf, 2.0, 5.0])],
    "none": [np.array([np.nan])], "wide": [np.array([s * 10.0**k for k in range(-30, 30) for s in (1, -1)])], None: [np.array([3.0])],
}


def raw(x, kind):
    if kind == "bfloat16":
        return (x.astype("<f4").view("<u4") >> 16).astype("<u2")
    return x.astype({"float16": "<f2", "float32": "<f4", "float64": "<f8"}[kind])


def seen(x, kind):
    r = raw(x, kind)
    return ((r.astype("<u4") << 16).view("<f4") if kind == "bfloat16" else r).astype(np.float64)


@pytest.mark.filterwarnings("ignore:overflow")
@pytest.mark.parametrize("kind, form", [("float32", "binary"), ("float64", "binary"), ("float16", "binary"), ("bfloat16", "binary"), ("float32", "array<float>"), ("float64", "array<double>")])
def test_statistics_are_numpy_s(spark, kind, form):
    rows = [(g, bytearray(raw(x, kind).tobytes()) if form == "binary" else seen(x, kind).tolist()) for g, xs in GROUPS.items() for x in xs] + [("normal", None)]
    df = spark.createDataFrame(rows, f"g string, v {form}").repartition(3)
    got = {r.g: r for r in tensors.moments(df, ["g"], "v", kind).collect()}
    q = {r.g: r for r in tensors.buffer_quantiles(df, ["g"], "v", kind).collect()}
    for g, xs in GROUPS.items():
        own = np.concatenate([seen(x, kind) for x in xs])
        good = own[np.isfinite(own)]
        r = got[g]
        assert r.numel == len(own) and r.finite_fraction == len(good) / len(own)
        if not len(good):
            assert (r.mean, r.std, r.min) == (None, None, None) and g not in q
            continue
        assert (r.min, r.max) == (good.min(), good.max())
        assert math.isclose(r.mean, good.mean(), rel_tol=1e-12, abs_tol=1e-12) and math.isclose(r.std, good.std(), rel_tol=1e-6, abs_tol=1e-12) and math.isclose(r.rms, np.sqrt((good**2).mean()), rel_tol=1e-12)
        assert [q[g][n] for n in QUANTILES] == pytest.approx(np.quantile(good, list(QUANTILES.values())).tolist(), rel=1e-12, abs=0)


def test_no_values_no_groups(spark):
    df = spark.createDataFrame([], "g string, v binary")
    assert tensors.moments(df, ["g"], "v").count() == 0 and tensors.buffer_quantiles(df, ["g"], "v").count() == 0
