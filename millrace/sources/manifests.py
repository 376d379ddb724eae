"""Manifests of token shards as DataFrames: one row for a manifest, a row for each shard once it is adapted.

A manifest is a JSON object: format, tokenizer, splits (name -> tokens, documents, shards), interleave.sources (source_id, weight,
major, shards) and validation_source_weights, each optional. Files are listed and sized by Spark's reader, which opens no content.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.packing import EOD, MAJOR_SHARE, VOCABULARY
from millrace.sources.shards import FORMAT, MANIFEST

SHARD = "struct<path:string,tokens_path:string,index:string,index_path:string,tokens:bigint,documents:bigint,source_id:string,source:string>"
SCHEMA = (
    f"format string, splits map<string,struct<tokens:bigint,documents:bigint,shards:array<{SHARD}>>>, "
    f"interleave struct<sources:array<struct<source_id:string,weight:double,major:boolean,shards:array<{SHARD}>>>>, validation_source_weights map<string,double>"
)
# Names of the two readings of a manifest.
CANONICAL, LEGACY = "canonical_interleave_v1", "datamix_v2_filename_prefix_v1"


def parsed(spark: SparkSession, path: str) -> dict:
    """The JSON object of a file, which Spark finds and reads."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, dict):
        raise ValueError(f"a JSON object is needed: {path}")
    return found


def opened(spark: SparkSession, folder: str, tokenizer: str, sha256: str) -> dict:
    """The folder's manifest, which must name the same tokenizer by its SHA-256, or a new one."""
    if not files(spark, folder, MANIFEST).isEmpty():
        found = parsed(spark, f"{folder}/{MANIFEST}")
        if (found.get("tokenizer") or {}).get("sha256") != sha256:
            raise ValueError(f"{folder} was made with another tokenizer")
        return found
    return {"schema_version": 1, "format": FORMAT, "eod_token_id": EOD, "tokenizer": {"path": tokenizer, "sha256": sha256, "vocab_size": VOCABULARY}, "splits": {}, "interleave": {"sources": []}}


def frame(spark: SparkSession, manifest: dict) -> DataFrame:
    """A manifest as one row. Shards given as bare paths, and the flat list of ShardWriter, are put under splits."""
    splits = {k: dict(v) for k, v in (manifest.get("splits") or {}).items()}
    if "splits" not in manifest:
        for s in manifest.get("shards") or []:
            splits.setdefault(s.get("split") or "train", {}).setdefault("shards", []).append(s)
    for v in splits.values():
        if v.get("shards") is not None:
            v["shards"] = [{"path": s} if isinstance(s, str) else s for s in v["shards"]]
    value = json.dumps(manifest | {"splits": splits})
    return read(spark.createDataFrame([(value,)], "value string"))


def read(manifests: DataFrame) -> DataFrame:
    """JSON texts (value) as rows of the members that count here; malformed ones are an error."""
    return manifests.select(F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def need(ok: Column, value: Column, *message: Column | str) -> Column:
    """value where ok is true; an error else."""
    said = F.concat(*(F.lit(m) if isinstance(m, str) else F.coalesce(m, F.lit("null")) for m in message))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(said))


def inside(path: Column) -> Column:
    """The path if it stays within its manifest's folder: not empty, not absolute, no scheme, no step up; an error else."""
    return need((path != "") & ~path.rlike(r"^([/\\]|[^/]*:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|\z)"), path, "a shard path leaves its folder: ", path)


def listed(shard: Column) -> list[Column]:
    """Columns of a shard's declaration, its two aliases settled."""
    path, index = F.coalesce(shard["path"], shard["tokens_path"]), F.coalesce(shard["index"], shard["index_path"])
    return [inside(path).alias("path"), inside(index).alias("index"), shard["tokens"].alias("tokens"), shard["documents"].alias("documents")]


def canonical(manifest: DataFrame) -> DataFrame:
    """Shards of interleave.sources: (source_id, weight, major, place, path, index, tokens, documents). Whatever split they are of."""
    s = F.col("s")
    sources = manifest.select(F.explode("interleave.sources").alias("s"))
    name = need(s["source_id"] != "", s["source_id"], "a source has no source_id")
    weight = need(s["weight"].isNotNull(), s["weight"], "no weight is given for source ", s["source_id"])
    major = need(s["major"].isNotNull(), s["major"], "major must be given for source ", s["source_id"])
    shards = need(F.size(s["shards"]) > 0, s["shards"], "no shards are listed for source ", s["source_id"])
    return sources.select(name.alias("source_id"), weight.alias("weight"), major.alias("major"), F.posexplode(shards).alias("place", "shard")).select("source_id", "weight", "major", "place", *listed(F.col("shard")))


def legacy(manifest: DataFrame, split: str = "train", least: float = MAJOR_SHARE) -> DataFrame:
    """Shards of a split, columns as in canonical: the source is the one declared or that of the file's name, its weight its share of
    the declared tokens, and major from a share of least on."""
    known = need(F.col("format") == FORMAT, F.col("splits")[split]["shards"], "without sources the format must be ", FORMAT)
    there = need(F.col("splits")[split]["shards"].isNotNull(), known, f"the manifest lists neither sources nor shards of {split}")
    shards = manifest.select(F.posexplode(there).alias("place", "shard"))
    path = need(F.col("shard.path").isNotNull(), F.col("shard.path"), "a shard has no path")
    named = shards.select(F.coalesce(F.col("shard.source_id"), T.legacy_source_id(path, split)).alias("source_id"), "place", *listed(F.col("shard")))
    per = named.groupBy("source_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("__n"))
    total = per.agg(F.sum("__n").alias("__total"))
    share = need(F.col("__total") > 0, F.col("__n") / F.col("__total"), "the shards declare no tokens")
    weights = per.join(F.broadcast(total), F.lit(True)).select("source_id", share.alias("weight"))  # total: one row
    return named.join(weights, "source_id").select("source_id", "weight", (F.col("weight") >= least).alias("major"), "place", "path", "index", "tokens", "documents")


def adapted(manifest: DataFrame, split: str = "train", least: float = MAJOR_SHARE) -> DataFrame:
    """canonical where the manifest lists sources, else legacy, plus adapter, the name of the reading."""
    has = F.col("interleave.sources").isNotNull()
    return canonical(manifest.where(has)).withColumn("adapter", F.lit(CANONICAL)).unionByName(legacy(manifest.where(~has), split, least).withColumn("adapter", F.lit(LEGACY)))


def files(spark: SparkSession, folder: str, pattern: str = "*.{bin,idx}") -> DataFrame:
    """(name, bytes) of the files below a folder; name is the path from there."""
    at = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    root = folder.split("://", 1)[-1].rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.substring_index(at, f"{root}/", -1).alias("name"), F.col("length").alias("bytes"))


def with_files(shards: DataFrame, found: DataFrame) -> DataFrame:
    """shards with both counts taken from their files where none are declared. A missing file, one that holds no whole number of
    values, or another count than declared is an error."""
    bins, idxs = (found.select(F.col("name").alias(n), F.col("bytes").alias(f"__{n}")) for n in ("path", "index"))
    joined = shards.join(bins, "path", "left").join(idxs, "index", "left")

    def count(file: str, width: int, what: str, less: int) -> Column:
        have, said = F.col(f"__{file}"), F.col(what)
        n = (have / width).cast("long") - less
        same = need(said.isNull() | (said == n), n, f"another number of {what} is declared for ", F.col(file))
        return need(have.isNotNull(), need(have % width == 0, same, "not a whole number of values: ", F.col(file)), "a shard's file is missing: ", F.col(file))

    return joined.withColumns({"tokens": count("path", 2, "tokens", 0), "documents": count("index", 8, "documents", 1)}).select(shards.columns)


def validation_sources(manifest: DataFrame) -> DataFrame:
    """(source, path, weight) of the validation split's shards: sources without a name are 'all', weights 1 unless given."""
    shards = manifest.select(F.explode("splits.validation.shards").alias("s"), F.col("validation_source_weights").alias("w"))
    given = [F.when(F.col(c) != "", F.col(c)) for c in ("s.source_id", "s.source")]
    named = shards.select(F.coalesce(*given, F.lit("all")).alias("source"), inside(F.col("s.path")).alias("path"), "w")
    return named.select("source", "path", F.coalesce(F.try_element_at("w", F.col("source")), F.lit(1.0)).alias("weight"))


def listed_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, weight) of a JSON object, or of its member sources: each name has a path, or an object of path or paths and weight."""
    found = parsed(spark, path)
    rows = []
    for name, v in found.get("sources", found).items():
        v = {"path": v} if isinstance(v, str) else v
        rows += [(name, p, float(v.get("weight", 1.0))) for p in v.get("paths") or [v["path"]]]
    return spark.createDataFrame(rows, "source string, path string, weight double")
