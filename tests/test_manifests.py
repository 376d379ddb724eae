import json

import numpy as np
import pytest

from millrace.sources import manifests as M
from millrace.sources import shards as S


def shard(root, name, offsets, **more):
    np.zeros(offsets[-1], dtype="<u2").tofile(root / f"{name}.bin")
    np.array(offsets, dtype="<u8").tofile(root / f"{name}.idx")
    return {"path": f"{name}.bin", "index": f"{name}.idx", "tokens": offsets[-1], "documents": len(offsets) - 1} | more


def rows(df):
    return sorted(tuple(r[c] for c in ("source_id", "weight", "major", "path", "tokens", "documents")) for r in df.collect())


def test_sources_as_declared(spark, tmp_path):
    a, b = shard(tmp_path, "a", [0, 2, 3]), shard(tmp_path, "b", [0, 4])
    b["tokens_path"], b["index_path"] = b.pop("path"), b.pop("index")
    m = {"interleave": {"sources": [{"source_id": "x", "weight": 2, "major": False, "shards": [a]}, {"source_id": "y", "weight": 0.5, "major": True, "shards": [b]}]}}
    got = M.adapted(M.frame(spark, m))
    assert {r.adapter for r in got.collect()} == {M.CANONICAL}
    assert rows(M.with_files(got, M.files(spark, str(tmp_path)))) == [("x", 2.0, False, "a.bin", 3, 2), ("y", 0.5, True, "b.bin", 4, 1)]


def test_sources_by_file_names(spark, tmp_path):
    listed = [shard(tmp_path, n, o) for n, o in (("web-x-train-00000", [0, 90]), ("web-x-train-00001", [0, 105]), ("other-y", [0, 4]), ("jp-train-00000", [0, 1]))]
    m = {"format": S.FORMAT, "splits": {"train": {"shards": listed}}}
    got = rows(M.adapted(M.frame(spark, m)))
    assert got == [("jp", 0.005, False, "jp-train-00000.bin", 1, 1), ("other", 0.02, True, "other-y.bin", 4, 1), ("web-x", 0.975, True, "web-x-train-00000.bin", 90, 1), ("web-x", 0.975, True, "web-x-train-00001.bin", 105, 1)]


SOURCE = {"source_id": "x", "weight": 1, "major": True, "shards": [{"path": "a.bin", "index": "a.idx"}]}


@pytest.mark.parametrize(
    "change, said",
    [({"source_id": ""}, "no source_id"), ({"major": None}, "major must"), ({"weight": None}, "no weight"), ({"shards": []}, "no shards"), *(({"shards": [{"path": p, "index": "a.idx"}]}, "leaves its folder") for p in ("../a.bin", "/a.bin", "b/../../a.bin", "s3://b/a.bin", "", None))],
)
def test_faulty_sources(spark, change, said):
    with pytest.raises(Exception, match=said):
        M.adapted(M.frame(spark, {"interleave": {"sources": [SOURCE | change]}})).collect()


@pytest.mark.parametrize("m, said", [({"splits": {}}, "neither sources nor"), ({"format": "x", "splits": {"train": {"shards": ["a.bin"]}}}, "format must be"), ({"format": S.FORMAT, "splits": {"train": {"shards": [{"path": "a-1.bin", "index": "a-1.idx"}]}}}, "declare no tokens")])
def test_faulty_splits(spark, m, said):
    with pytest.raises(Exception, match=said):
        M.adapted(M.frame(spark, m)).collect()


@pytest.mark.parametrize("change, said", [({"tokens": 4}, "another number of tokens"), ({"documents": 1}, "another number of documents"), ({"path": "none.bin"}, "file is missing"), ({"path": "odd.bin"}, "not a whole number")])
def test_files_are_held_against_the_counts(spark, tmp_path, change, said):
    (tmp_path / "odd.bin").write_bytes(b"123")
    m = {"interleave": {"sources": [SOURCE | {"shards": [shard(tmp_path, "a", [0, 2, 3]) | change]}]}}
    with pytest.raises(Exception, match=said):
        M.with_files(M.adapted(M.frame(spark, m)), M.files(spark, str(tmp_path))).collect()


def test_counts_come_from_the_files(spark, tmp_path):
    shard(tmp_path, "a", [0, 2, 3])
    assert rows(M.with_files(M.adapted(M.frame(spark, {"interleave": {"sources": [SOURCE]}})), M.files(spark, str(tmp_path)))) == [("x", 1.0, True, "a.bin", 3, 2)]


def test_written_shards_are_adapted(spark, tmp_path):
    df = spark.createDataFrame([("web-x", k, [k] * 3) for k in range(4)], "source_id string, doc_seq long, tokens array<int>")
    S.write_shards(df.coalesce(1), str(tmp_path / "out"))
    got = M.adapted(M.frame(spark, M.parsed(spark, str(tmp_path / "out/manifest.json"))))
    checked = M.with_files(got, M.files(spark, str(tmp_path / "out"))).collect()
    assert {(r.source_id, r.weight, r.major, r.adapter) for r in checked} == {("web-x", 1.0, True, M.CANONICAL)} and sum(r.tokens for r in checked) == 12


def test_validation_sources(spark, tmp_path):
    m = {"splits": {"validation": {"shards": ["p.bin", {"path": "q.bin", "source": "s"}, {"path": "r.bin", "source_id": "t", "source": "s"}]}}, "validation_source_weights": {"s": 3}}
    assert sorted(map(tuple, M.validation_sources(M.frame(spark, m)).collect())) == [("all", "p.bin", 1.0), ("s", "q.bin", 3.0), ("t", "r.bin", 1.0)]
    with pytest.raises(Exception, match="leaves its folder"):
        M.validation_sources(M.frame(spark, {"splits": {"validation": {"shards": ["../p.bin"]}}})).collect()
    (tmp_path / "v.json").write_text(json.dumps({"sources": {"a": "1.bin", "b": {"paths": ["2.bin", "3.bin"], "weight": 2}, "c": {"path": "4.bin"}}}))
    assert sorted(map(tuple, M.listed_sources(spark, str(tmp_path / "v.json")).collect())) == [("a", "1.bin", 1.0), ("b", "2.bin", 2.0), ("b", "3.bin", 2.0), ("c", "4.bin", 1.0)]


def test_a_manifest_belongs_to_one_tokenizer(spark, tmp_path):
    new = M.opened(spark, str(tmp_path), "t.json", "1f")
    assert new["splits"] == {} and new["tokenizer"]["vocab_size"] == 49_152
    (tmp_path / "manifest.json").write_text(json.dumps(new))
    assert M.opened(spark, str(tmp_path), "t.json", "1f") == new
    with pytest.raises(ValueError, match="another tokenizer"):
        M.opened(spark, str(tmp_path), "t.json", "2e")
