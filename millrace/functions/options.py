"""Command lines held as arrays of strings: the value of an option, and its replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _names(word: Column, option: str) -> Column:
    return (word == option) | word.startswith(f"{option}=")


def option_value(words: Column, option: str, default: str | None = None) -> Column:
    """Value of the first --option v or --option=v. An option at the end without a value is an error."""
    at = F.array_position(F.transform(words, lambda w: _names(w, option)), F.lit(True))
    word = F.get(words, (at - 1).cast("int"))
    after = F.when(at < F.size(words), F.get(words, at.cast("int"))).otherwise(F.raise_error(F.lit(f"{option} has no value")).cast("string"))
    return F.when(at == 0, F.lit(default)).when(word == option, after).otherwise(F.substring(word, F.lit(len(option) + 2), F.char_length(word)))


def replace_option(words: Column, option: str, value: str) -> Column:
    """words with every occurrence as --option value, put at the end if there is none; a value after a bare option goes."""
    pair, none = F.array(F.lit(option), F.lit(value)), F.array().cast("array<string>")

    def step(state: Column, word: Column) -> Column:
        more = F.when(state["skip"], none).when(_names(word, option), pair).otherwise(F.array(word))
        return F.struct(
            F.concat(state["out"], more).alias("out"),
            (~state["skip"] & (word == option)).alias("skip"),
            (state["found"] | (~state["skip"] & _names(word, option))).alias("found"),
        )

    start = F.struct(none.alias("out"), F.lit(False).alias("skip"), F.lit(False).alias("found"))
    return F.aggregate(words, start, step, lambda s: F.when(s["found"], s["out"]).otherwise(F.concat(s["out"], pair)))


def sorted_map(key: str, value: str) -> Column:
    """Aggregate: a map from key to value, in the order of the keys. Keys must be distinct within a group, and few."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
