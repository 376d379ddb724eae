"""Benchmark files: JSON records a line, question XML, and the one text of each example that is matched.

Files are read as they lie in a folder; nothing is fetched. Every loader gives (benchmark, text, first, second): first and second
are the parts of benchmarks that matching.parts scores by part, null for the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Characters that end a line of a JSON-records file, \r\n being one end.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def split_lines(value: Column) -> Column:
    """Lines of a text by all of LINE_ENDS, without an empty one after the last end; null for null."""
    parts = F.split(value, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def json_records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of the schema, one for each non-blank line of the files; a line that isn't such an object is an error.

    Spark cuts the files at \\n, so they are read in pieces; the other line ends are cut within a piece.
    """
    lines = spark.read.text(paths, lineSep="\n").select(F.explode(split_lines(F.col("value"))).alias("line"))
    return lines.where(~T.is_blank(F.col("line"))).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def needed(name: str) -> Column:
    """A string field that has to be there."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"a record lacks {name}")).cast("string"))


def written(name: str) -> Column:
    """A field as text; null is written out as None, as the texts that indexes were built from have it."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _rows(df: DataFrame, benchmark: str, text: Column, first: Column | None = None, second: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(benchmark).alias("benchmark"), text.alias("text"), (none if first is None else first).alias("first"), (none if second is None else second).alias("second"))


def jcommonsenseqa(df: DataFrame) -> DataFrame:
    """question, choice0..choice4."""
    return _rows(df, "jcommonsenseqa", F.concat_ws(" ", needed("question"), *(needed(f"choice{i}") for i in range(5))))


def jnli(df: DataFrame) -> DataFrame:
    """sentence1, sentence2."""
    return _rows(df, "jnli", F.concat_ws(" ", written("sentence1"), written("sentence2")))


def jmmlu(df: DataFrame) -> DataFrame:
    """question, A, B, C, D; a column that isn't there counts as empty."""
    return _rows(df, "jmmlu", F.concat_ws(" ", *(written(c) if c in df.columns else F.lit("") for c in ("question", "A", "B", "C", "D"))))


#: Schema of the articles of the reading benchmark.
ARTICLES = "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<question: string, answers: array<struct<text: string>>>>>>>>"


def jsquad(df: DataFrame) -> DataFrame:
    """Articles (ARTICLES): jsquad_context of each paragraph, jsquad_qa of each question with all its answers."""
    paragraphs = df.select(F.explode("data").alias("a")).select(F.explode("a.paragraphs").alias("p")).select("p.context", "p.qas")
    asked = paragraphs.select(F.explode("qas").alias("q")).select(F.col("q.question").alias("question"), F.coalesce(F.col("q.answers.text"), F.array().cast("array<string>")).alias("answers"))
    answered = T.stripped(F.concat_ws(" ", written("question"), F.array_join("answers", " ")))
    return _rows(paragraphs, "jsquad_context", F.col("context")).unionByName(_rows(asked, "jsquad_qa", answered))


def questions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(xml) of every question element of XML files. Files are cut where such an element ends, so they are read in pieces."""
    pieces = spark.read.text(paths, lineSep="</question>")
    inner = F.regexp_extract("value", r"(?s)<question(?:\s[^>]*)?>.*\z", 0)
    return pieces.select(inner.alias("xml")).where("xml != ''").select(F.concat("xml", F.lit("</question>")).alias("xml"))


def niilc(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Question elements: the first text and all answers, of those with a text. Malformed XML is an error."""

    def leading(tag: str) -> Column:
        found = F.xpath(F.col(xml), F.lit(f"//{tag}/node()[1][self::text()]"))
        return F.filter(F.transform(found, T.stripped), lambda t: t != "")

    got = df.select(leading("text").alias("texts"), leading("answer").alias("answers")).where(F.size("texts") > 0)
    return _rows(got, "niilc", F.array_join(F.concat(F.slice("texts", 1, 1), F.col("answers")), " "))


def _pair(benchmark: str, first: str, second: str, between: str) -> Callable[[DataFrame], DataFrame]:
    def rows(df: DataFrame) -> DataFrame:
        return _rows(df, benchmark, F.concat(written(first), F.lit(between), written(second)), F.col(first), F.col(second))

    rows.__doc__ = f"{first}, {second}."
    return rows


gsm8k = _pair("gsm8k", "question", "answer", " ")
humaneval = _pair("humaneval", "prompt", "canonical_solution", "\n")
mbpp = _pair("mbpp", "text", "code", "\n")

#: Loader of each benchmark, from the table of its file.
LOADERS = {"jcommonsenseqa": jcommonsenseqa, "jnli": jnli, "jsquad": jsquad, "niilc": niilc, "jmmlu": jmmlu, "gsm8k": gsm8k, "humaneval": humaneval, "mbpp": mbpp}


def canonical(tables: dict[str, DataFrame]) -> DataFrame:
    """(benchmark, text, first, second) of all given benchmarks; an unknown name is an error."""
    if unknown := sorted(set(tables) - set(LOADERS)) or not tables:
        raise ValueError(f"no loader for {unknown}" if tables else "no benchmark given")
    first, *rest = (LOADERS[name](df) for name, df in tables.items())
    for df in rest:
        first = first.unionByName(df)
    return first
