"""Text normalisation and n-grams as column expressions.

All lengths are in code points. The Unicode white-space class removes exactly what Python's str.split() treats as space.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.tables import bounded

# Fixed values.
CHAR_GRAM, WORD_GRAM = 20, 13
MIN_SHORT_KEY, MIN_SUBSTRING_KEY = 8, 12
MIN_DISTINCT, MIN_SPAN_CHARS, MIN_SPAN_WORDS = 2, 30, 20
CJK, CJK_SHARE = "[぀-ヿ一-鿿]", 0.15
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
#: Texts of these characters are their own NFKC form: ASCII and precomposed Latin letters, without compatibility or combining ones.
STABLE = "^[\\x00-\\x7fÀ-ıĴ-ľŁ-ňŊ-ž]*$"


def is_cjk(text: Column) -> Column:
    """At least 15 % of the raw text's characters are kana or CJK ideographs; false for empty and null."""
    return F.coalesce(F.regexp_count(text, F.lit(CJK)) / F.nullif(F.char_length(text), F.lit(0)) >= CJK_SHARE, F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def with_nfkc(df: DataFrame, text: str = "text", out: str = "nfkc") -> DataFrame:
    """df plus the NFKC form of text. Only rows that can change pass through Python: the two kinds are split and united again."""
    bounded(df.sparkSession)
    ascii_ = F.octet_length(text) == F.char_length(text)  # most texts; the expression is slower by far
    stable = F.coalesce(ascii_ | F.col(text).rlike(STABLE), F.lit(True))
    return df.where(stable).withColumn(out, F.col(text)).unionByName(df.where(~stable).withColumn(out, _nfkc(text)))


def chars_of(nfkc: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(nfkc), SPACE, "")


def words_of(nfkc: Column) -> Column:
    """ASCII letter and digit runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(nfkc), F.lit("([0-9a-z]+)"), F.lit(1))


def key_of(text: Column, nfkc: Column) -> Column:
    """What a record is compared by as a whole: its characters if it is CJK text, else its words."""
    return F.when(is_cjk(text), chars_of(nfkc)).otherwise(F.array_join(words_of(nfkc), " "))


def windows(items: Column, n: int, joiner: str) -> Column:
    """All windows of n array items, joined; empty if there are fewer (sequence() would count down).

    The array is bound to a variable first: written into the inner function, it would be computed anew for each window.
    """

    def cut(a: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.array_join(F.slice(a, i + 1, n), joiner))
        return F.when(F.size(a) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(items), cut), F.lit(0))


def char_grams(nfkc: Column) -> Column:
    return windows(F.filter(F.split(chars_of(nfkc), ""), lambda c: c != ""), CHAR_GRAM, "")


def word_grams(nfkc: Column) -> Column:
    return windows(words_of(nfkc), WORD_GRAM, " ")


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "") == ""


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of the Unicode class."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def safe_source_id(value: Column) -> Column:
    """The id itself; an error unless it is a letter or digit followed by letters, digits, dots, underscores or hyphens."""
    return F.when(value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]*\z"), value).otherwise(F.raise_error(F.concat(F.lit("not a source id: "), F.coalesce(value, F.lit("null")))))


def legacy_source_id(path: Column, split: str) -> Column:
    """Source of a shard file name: what stands before -<split>-<number>.bin, or else before the first hyphen of the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    found = F.regexp_extract(name, rf"\A(.+)-{split}-\d+\.bin\z", 1)
    return F.when(found != "", found).otherwise(F.substring_index(stem, "-", 1))


def gram_hash(gram: Column) -> Column:
    """64-bit hash of a gram (equal grams, equal hashes), where strings would be too wide for a join."""
    return F.xxhash64(gram)
