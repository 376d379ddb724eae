import gzip
import json

import numpy as np
import pytest

from millrace.sources import shards, text_files
from millrace.sources.shards import ShardSource
from millrace.streaming import packer


def test_text_and_json_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one \r\n\n  \ntwo\rthree still".encode())
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "x", "text": "last"}\n\n{"text": ""}\n{"other": 1, "text": "é\\n"}\n')
    rows = text_files.read_documents(spark, str(tmp_path)).orderBy("path", "line").collect()
    assert [(r.line, r.text) for r in rows] == [(1, "one "), (4, "two"), (5, "three still"), (1, "last"), (4, "é\n")]


@pytest.mark.parametrize("line", ['{"text": 12}', '{"no": "text"}', "{broken", '["text"]', '{"text": null}'])
def test_json_without_a_text_is_an_error(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text('{"text": "fine"}\n' + line + "\n")
    with pytest.raises(Exception, match="needs a text field"):
        text_files.read_documents(spark, str(tmp_path)).collect()


def test_invalid_utf8_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(Exception):
        text_files.read_documents(spark, str(tmp_path)).collect()


def test_shards_come_back(spark, tmp_path):
    spark.dataSource.register(ShardSource)
    rows = [("s", k, [k, 65535, 4] * (k % 3)) for k in range(20)]
    df = spark.createDataFrame(rows, "source_id string, doc_seq long, tokens array<int>").repartition(3)
    df.write.format("token_shards").mode("append").save(str(tmp_path / "out"))
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert sum(s["documents"] for s in manifest["shards"]) == 20 and not list((tmp_path / "out").glob("*.tmp"))
    back = spark.read.format("token_shards").load(str(tmp_path / "out"))
    assert sorted(map(list, (r.tokens for r in back.collect()))) == sorted(t for *_, t in rows)
    shard = manifest["shards"][0]
    np.array([1, 0], dtype="<u8").tofile(tmp_path / "out" / shard["index"])
    with pytest.raises(Exception, match="offsets"):
        back.collect()


def tokens_of(spark, path):
    return sorted(tuple(r.tokens) for r in spark.read.format("token_shards").load(path).collect())


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    spark.dataSource.register(ShardSource)
    schema, out = "source_id string, doc_seq long, tokens array<int>", str(tmp_path / "out")
    first = spark.createDataFrame([("s", k, [k]) for k in range(6)], schema)
    shards.write_shards(first, out)
    shards.write_shards(first, out)
    assert tokens_of(spark, out) == sorted((k,) for k in [*range(6)] * 2)
    first.repartition(3).write.format("token_shards").mode("overwrite").save(out)
    first.coalesce(1).write.format("token_shards").mode("overwrite").save(out)
    assert tokens_of(spark, out) == [(k,) for k in range(6)]
    listed = json.loads((tmp_path / "out/manifest.json").read_text())["shards"]
    assert {p.name for p in (tmp_path / "out").glob("*.bin")} == {s["path"] for s in listed} and all(s["source_id"] == "s" and len(s["sha256"]) == 64 for s in listed)
    with pytest.raises(ValueError, match="no documents"):
        shards.write_shards(first.limit(0), out)


def test_documents_keep_their_order_within_a_source(spark, tmp_path):
    rows = [(s, k, [k]) for k in range(30, 0, -1) for s in "ab"]
    shards.write_shards(spark.createDataFrame(rows, "source_id string, doc_seq long, tokens array<int>"), str(tmp_path / "out"), "validation")
    found = spark.read.format("token_shards").option("split", "validation").load(str(tmp_path / "out")).collect()
    for shard in {r.shard for r in found}:
        own = [r.tokens[0] for r in sorted((r for r in found if r.shard == shard), key=lambda r: r.doc_seq)]
        assert own == sorted(own)
    assert spark.read.format("token_shards").option("split", "train").load(str(tmp_path / "out")).count() == 0


def test_wrong_counts_and_paths_are_refused(spark, tmp_path):
    spark.dataSource.register(ShardSource)
    for name in ("../x.bin", "/x.bin", "", "a/../../x", "file://x"):
        with pytest.raises(ValueError):
            shards.safe_path(name)
    shards.write_shards(spark.createDataFrame([("s", 0, [1, 2])], "source_id string, doc_seq long, tokens array<int>"), str(tmp_path / "out"))
    m = json.loads((tmp_path / "out/manifest.json").read_text())
    m["shards"][0]["tokens"] = 3
    (tmp_path / "out/manifest.json").write_text(json.dumps(m))
    with pytest.raises(Exception, match="the manifest 3"):
        spark.read.format("token_shards").load(str(tmp_path / "out")).collect()


def test_ids_beyond_16_bits_are_refused(spark, tmp_path):
    spark.dataSource.register(ShardSource)
    with pytest.raises(Exception):
        spark.createDataFrame([("s", 0, [70000])], "source_id string, doc_seq long, tokens array<int>").write.format("token_shards").mode("append").save(str(tmp_path / "out"))


def test_packer_keeps_its_tail_over_restarts(spark, tmp_path):
    schema = "source_id string, doc_seq long, tokens array<int>"
    flat = []
    for k in range(3):
        tokens = list(range(k * 7, k * 7 + 7))
        flat += tokens
        spark.createDataFrame([("s", k, tokens)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        packed = packer.pack(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5)
        q = packed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(90)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("row").collect()
    assert [t for r in rows for t in r.tokens] == flat[:20] and [r.row for r in rows] == [0, 1, 2, 3]


SHARD_SCHEMA = "source_id string, doc_seq long, tokens array<int>"


def test_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    out = str(tmp_path / "out")

    def write(k):
        shards.write_shards(spark.createDataFrame([(f"s{k % 3}", d, [100 * k + d]) for d in range(4)], SHARD_SCHEMA), out, "validation" if k == 5 else "train", weight=str(k % 3 + 1))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    assert tokens_of(spark, out) == sorted((100 * k + d,) for k in range(6) for d in range(4))
    m = json.loads((tmp_path / "out/manifest.json").read_text())
    assert {k: (v["tokens"], v["documents"]) for k, v in m["splits"].items()} == {"train": (20, 20), "validation": (4, 4)}
    assert [(s["source_id"], s["weight"], s["major"], sum(x["tokens"] for x in s["shards"])) for s in m["interleave"]["sources"]] == [("s0", 1.0, True, 8), ("s1", 2.0, True, 8), ("s2", 3.0, True, 4)]
    assert len(list((tmp_path / "out/_commits").glob("*.json"))) == 6 and not list((tmp_path / "out").rglob("*.tmp"))


def test_a_commit_that_comes_in_between_is_put_in(tmp_path, monkeypatch):
    """Another writer's commit after this one has listed them and before it writes the manifest."""
    fs, folder = shards._open(str(tmp_path))
    (tmp_path / "_commits").mkdir()
    said = lambda k: {"add": [{"path": f"s-{k}.bin", "index": f"s-{k}.idx", "source_id": "s", "split": "train", "tokens": 1, "documents": 1}], "remove": [], "split": "train", "weight": 1.0, "major": True, "tokenizer": None}
    shards._put(fs, f"{folder}/_commits/1.json", said(1))
    put, late = shards._put, [said(2)]

    def slow(fs, path, value):
        if path.endswith("manifest.json") and late:
            put(fs, f"{folder}/_commits/2.json", late.pop())
        put(fs, path, value)

    monkeypatch.setattr(shards, "_put", slow)
    shards.settle(fs, folder)
    assert [s["path"] for s in json.loads((tmp_path / "manifest.json").read_text())["shards"]] == ["s-1.bin", "s-2.bin"]


def test_manifests_from_elsewhere_are_taken_over(spark, tmp_path):
    np.array([5, 4], dtype="<u2").tofile(tmp_path / "old-train-00000.bin")
    np.array([0, 2], dtype="<u8").tofile(tmp_path / "old-train-00000.idx")
    record = {"source_id": "old", "path": "old-train-00000.bin", "index": "old-train-00000.idx", "tokens": 2, "documents": 1}
    manifest = {"schema_version": 1, "format": "document-indexed-uint16-shards", "eod_token_id": 4, "tokenizer": {"path": "t", "sha256": "aa", "vocab_size": 49152}, "splits": {"train": {"tokens": 2, "documents": 1, "shards": [record]}}, "interleave": {"sources": [{"source_id": "old", "weight": 0.25, "major": False, "shards": [record]}]}, "validation_source_weights": {"x": 2.0}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    df = spark.createDataFrame([("new", 0, [7, 8, 4])], SHARD_SCHEMA)
    with pytest.raises(Exception, match="another tokenizer"):
        shards.write_shards(df, str(tmp_path), tokenizer="u", tokenizer_sha256="bb")
    shards.write_shards(df, str(tmp_path), minor="true", tokenizer="t", tokenizer_sha256="aa")
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert m["validation_source_weights"] == {"x": 2.0} and m["tokenizer"]["sha256"] == "aa" and m["splits"]["train"]["tokens"] == 5
    assert [(s["source_id"], s["weight"], s["major"]) for s in m["interleave"]["sources"]] == [("new", 1.0, False), ("old", 0.25, False)]
    assert tokens_of(spark, str(tmp_path)) == [(5, 4), (7, 8, 4)]
    with pytest.raises(Exception, match="positive"):
        shards.write_shards(df, str(tmp_path), weight="0")


@pytest.mark.parametrize("size", [1, 2, 5, 17, 64, 1 << 20])
def test_lines_are_numbered_over_splits_of_any_size(spark, tmp_path, size):
    text = "a\r\nbb\rccc\n\n\r\r\n\u00e9\u00e9\u00e9\n  \r\nlast but one\r\r\n\nno end"
    files = {"x.txt": text, "y.txt": text + "\r\n", "z.txt": "\r\n" * 9, "one.txt": "only", "none.txt": ""}
    for name, t in files.items():
        (tmp_path / name).write_bytes(t.encode())
    with gzip.open(tmp_path / "packed.txt.gz", "wb") as f:
        f.write(text.encode())
    files["packed.txt.gz"] = text
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in text_files.lines(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = []
    for name, t in files.items():
        cut = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        want += [(name, k + 1, v) for k, v in enumerate(cut if cut[-1] else cut[:-1])]
    assert got == sorted(want)


def test_errors_name_the_line_in_a_later_split(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "fine"}\n' * 40 + '{"text": 7}\n' + '{"text": "fine"}\n' * 40)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        with pytest.raises(Exception, match="a.jsonl:41 needs a text field"):
            text_files.read_documents(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shards_are_written_from_bounded_arrow_batches(spark, tmp_path):
    from pyspark.sql.datasource import DataSourceArrowWriter

    from millrace.functions.tables import BATCH_BYTES
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [("a", 0, [1, 2, 65535]), ("a", 1, None), ("b", 0, []), ("a", 2, [7])]
    df = spark.createDataFrame(rows, "source_id string, doc_seq long, tokens array<int>")
    shards.write_shards(df, str(tmp_path / "w"))
    assert issubclass(shards.ShardWriter, DataSourceArrowWriter)  # rows as Python lists of integers are many times larger
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    read = spark.read.format("token_shards").load(str(tmp_path / "w"))
    assert sorted((r.source_id, r.tokens) for r in read.collect()) == [("a", []), ("a", [1, 2, 65535]), ("a", [7]), ("b", [])]
