"""Validation windows against a reader that takes shards one after the other."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.plans import catalogue
from millrace.plans.settings import LENGTH, VALID
from millrace.sources import shards, windows


def folder(path, sizes, seed=3):
    rng, listed = np.random.default_rng(seed), []
    path.mkdir()
    for k, n in enumerate(sizes):
        tokens = rng.choice([4, 5, 6, 7, 8], n).astype("<u2")
        tokens.tofile(path / f"s{k % 3}-validation-{k:05d}.bin")
        np.array([0, n], dtype="<u8").tofile(path / f"s{k % 3}-validation-{k:05d}.idx")
        listed.append({"path": f"s{k % 3}-validation-{k:05d}.bin", "index": f"s{k % 3}-validation-{k:05d}.idx", "tokens": n, "documents": 1})
    (path / "manifest.json").write_text(json.dumps({"format": shards.FORMAT, "splits": {"validation": {"shards": listed}}}))
    return str(path), listed


def plain(path, listed, length, budget):
    """Windows in order until the budget is used up."""
    used, out = 0, []
    for k, s in enumerate(listed):
        values = np.fromfile(f"{path}/{s['path']}", "<u2")
        for w, start in enumerate(range(0, len(values) - length, length)):
            if used >= budget:
                return out
            own = values[start : start + length].tolist()
            valid = sum(t != 4 for t in own[:-1])
            used += valid
            out.append((s.get("source_id") or s["path"].split("-")[0], k, w, own, valid))
    return out


@pytest.mark.parametrize("budget", [0, 1, 50, 137, 400, 10**6])
def test_windows_equal_reading_in_order(spark, tmp_path, monkeypatch, budget):
    monkeypatch.setattr(windows, "AT_ONCE", 4)
    path, listed = folder(tmp_path / "data", [100, 8, 9, 0, 300, 64, 65, 200])
    got = sorted(map(tuple, windows.read_windows(spark, path, 8, budget).collect()), key=lambda r: r[1:3])
    assert got == plain(path, listed, 8, budget)


def test_no_file_past_the_budget_is_opened(spark, tmp_path):
    path, listed = folder(tmp_path / "data", [400] * 10)
    want = plain(path, listed, 8, 500)
    last = max(r[1] for r in want)
    for s in listed[last + 1 :]:
        (tmp_path / "data" / s["path"]).unlink()
    assert 0 < last < 5 and windows.read_windows(spark, path, 8, 500).count() == len(want)
    with pytest.raises(Exception, match="No such file"):
        windows.read_windows(spark, path, 8, 10**6).count()


def test_losses_by_source_and_weights(spark):
    w = spark.createDataFrame([(0, 0, "a", 10.0, 5), (0, 1, "a", 20.0, 5), (1, 0, "b", 5.0, 10)], "shard long, window long, source string, loss_sum double, valid long")
    assert sorted(map(tuple, metrics.source_nll(w, 100).collect())) == [("a", 3.0, 10, 0.5), ("b", 0.5, 10, 0.5)]
    given = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "source string, weight double")
    assert sorted(map(tuple, metrics.source_nll(w, 100, given).collect())) == [("a", 3.0, 10, 3.0), ("b", 0.5, 10, 1.0)]
    assert metrics.validation_nll(w, 100, given).first()[:] == ((3.0 * 3 + 0.5) / 4, 20, 2)


def test_query_of_windows_equals_reading_in_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalogue, "shared_folder", lambda spark: str(tmp_path / "out"))
    got = {r.source: tuple(r)[1:] for r in catalogue.QUERIES["validation_windows"](spark, "/root/testdata/sf0.001").collect()}
    listed = shards.declared(shards.manifest_of(str(tmp_path / "out")), "validation")
    want = {}
    for source, _, _, own, valid in plain(tmp_path / "out", listed, LENGTH, VALID):
        n, v, ids = want.get(source, (0, 0, 0))
        want[source] = (n + 1, v + valid, ids + sum(own))
    assert got == want
