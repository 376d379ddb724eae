"""Documents from text and JSON-lines files, plain or gzipped, UTF-8 strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

JSONL = r"\.jsonl(\.gz)?$"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, value): lines in file order from 1, ended by \\n, \\r\\n or \\r; invalid UTF-8 is an error. A byte order mark at a
    file's start isn't part of its text.

    Files are read in splits, by many tasks. A first pass counts the lines of each split; what the splits before it hold, and the
    place of a line in its own split, number it. Spark reads a split's lines in order, under numbers that rise by one.
    """
    own = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    read = spark.read.text(paths).select(own.alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    counted = read.groupBy("at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    ahead = Window.partitionBy("at.path").orderBy("at.split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = counted.select("at", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    line = F.col("before") + F.col("id") - F.col("first") + 1
    return read.join(splits, "at").select("at.path", line.alias("line"), F.decode(F.col("value").cast("binary"), "UTF-8").alias("value"))


def json_text(value: Column, where: Column) -> Column:
    """The string member text of a JSON object (the last of repeated keys); anything else is an error that names the place."""
    got = F.try_variant_get(F.try_parse_json(value), "$.text", "variant")
    ok = F.coalesce(F.schema_of_variant(got) == "STRING", F.lit(False))
    return F.when(ok, F.variant_get(got, "$", "string")).otherwise(F.raise_error(F.concat(where, F.lit(" needs a text field"))).cast("string"))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, text): non-blank lines of text files as they are, and the text of each JSON line; empty texts are skipped."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    some = lines(spark, paths).where(~T.is_blank(F.col("value")))
    where = F.concat_ws(":", "path", F.col("line").cast("string"))
    text = F.when(F.col("path").rlike(JSONL), json_text(F.col("value"), where)).otherwise(F.col("value"))
    return some.select("path", "line", text.alias("text")).where("text != ''")


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; each call adds whole files, so a stopped one adds nothing."""
    df.write.mode("append").json(path)
