"""Quality rules: an ordered decision list, learned by sequential covering from statistics of labelled documents.

Rules are grown and pruned as conjunctions of thresholds (grow on two thirds of the labelled rows by information gain, prune on
the last third), each covers some bad documents, and what it covers leaves before the next is learned. The list becomes
ordered Spark conditional expressions over the statistics, so it is applied inside the plan.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fields, kept, texts_of
from .sample import bounded_ids

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Labelled rows that the rules are fitted on, at most: those of smallest hash of doc_id.
SAMPLE = 20_000
#: Statistics that rules may test, all counts or shares of the whole text.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "long_line_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHER = ("n_lines", "n_upper", "n_marks", "n_digits", "n_long_lines")


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, covered = 0, -1
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 2 - max(covered, i - 1)
            covered = i + 2
    return total


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS and OTHER of one text."""
    words = text.encode().split()  # bytes split at exactly the six ASCII spaces
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return (
        n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words),
        len(lines), sum(1 for w in words if w.isupper()), text.count("!") + text.count("?"), sum(map(text.count, "0123456789")), sum(1 for x in lines if len(x) > 1000),
    )


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns plus COUNTS and OTHER as longs; a null text has zeros. Whole texts, one pass, no shuffle."""
    chosen = df.select(*kept(df, keep, *COUNTS, *OTHER, "base_failed", "kept", "rule"), df[text].alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in texts_of(batch, "__text")]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(COUNTS + OTHER))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *COUNTS, *OTHER])

    return arrow_map(chosen, rows, ", ".join([*fields(chosen.schema)[:-1], *(f"{c} long" for c in COUNTS + OTHER)]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Shares that rules test; 0 where a text has no word or no line."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "n_words"),
        "mark_share": share("n_marks", "n_words"), "digit_share": share("n_digits", "word_chars"), "long_line_share": share("n_long_lines", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """All tests must hold; a test is (feature, '<=' or '>', threshold). bad, good: what it covered when it was accepted."""

    tests: tuple[tuple[str, str, float], ...]
    bad: int
    good: int

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & (values[name] <= at if sign == "<=" else values[name] > at)
        return out

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, sign, at in self.tests:
            v = x[:, FEATURES.index(name)]
            out &= v <= at if sign == "<=" else v > at
        return out


def learn(x: np.ndarray, bad: np.ndarray, least_precision: float = 0.8, least_cover: int = 8, most_rules: int = 12, most_tests: int = 3) -> list[Rule]:
    """Ordered rules that predict bad rows. x has a column for each of FEATURES; rows must be in a fixed order.

    A rule must be right on least_precision of what it covers, on the growing and the pruning rows together, and cover
    least_cover bad rows; learning stops at the first that isn't. No bad rows, no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    for _ in range(most_rules):
        rows = np.flatnonzero(left)
        third = rows[2::3]
        grow = np.setdiff1d(rows, third)
        tests = _grown(x[grow], bad[grow], most_tests)
        tests = _pruned(tests, x[third], bad[third])
        if not tests:
            break
        rule = Rule(tuple(tests), 0, 0)
        hit = rule.covers(x) & left
        b, g = int((hit & bad).sum()), int((hit & ~bad).sum())
        if b < least_cover or b < least_precision * (b + g):
            break
        rules.append(Rule(rule.tests, b, g))
        left &= ~hit
    return rules


def _grown(x: np.ndarray, bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    inside, tests = np.ones(len(x), dtype=bool), []
    for _ in range(most):
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            v = x[inside, k]
            order = np.argsort(v, kind="stable")
            v, y = v[order], bad[inside][order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not cuts.size:
                continue
            p, n = np.cumsum(y)[cuts], np.cumsum(~y)[cuts]
            for sign, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0))), -1.0)
                if g.max() > gain:
                    i = int(g.argmax())
                    gain, best = float(g[i]), (name, sign, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
        if best is None:
            break
        tests.append(best)
        inside &= Rule((best,), 0, 0).covers(x)
    return tests


def _pruned(tests: list[tuple[str, str, float]], x: np.ndarray, bad: np.ndarray) -> list[tuple[str, str, float]]:
    """The shortest leading part of the tests with the best (bad - good) / covered on rows that didn't grow it."""

    def worth(n: int) -> float:
        hit = Rule(tuple(tests[:n]), 0, 0).covers(x)
        b, g = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (b - g) / (b + g) if b + g else -1.0

    return tests[: max(range(1, len(tests) + 1), key=lambda n: (worth(n), -n))] if tests else []


def fitted(df: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules from labelled rows; of at most sample of them, by hash of doc_id, a few numbers each come to the driver.

    Rows that fail the base rules already are left out. A doc_id with several labels counts as bad if any label is 0; null
    ids and null labels are left out.
    """
    values = features()
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    few = df.select("doc_id", df[text].alias("__text")).join(F.broadcast(bounded_ids(marked, "doc_id", sample)), "doc_id")
    rows = (
        with_statistics(few, ["doc_id", "__quality"], "__text")
        .where(~base_failed())
        .select("doc_id", "__quality", *(values[f].alias(f"__{f}") for f in FEATURES))
        .orderBy(F.xxhash64("doc_id"), "doc_id", *(f"__{f}" for f in FEATURES))
        .limit(sample)
        .collect()
    )
    if not rows:
        return []
    x = np.array([[r[f"__{f}"] for f in FEATURES] for r in rows], dtype=float)
    return learn(x, np.array([r["__quality"] == 0 for r in rows]))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """kept and rule (the number of the first rule that fires, from 1; 0 for the base rules; null if none)."""
    values = features()
    rule = F.when(base_failed(), F.lit(0))
    for k, r in enumerate(rules, 1):
        rule = rule.when(r.column(values), F.lit(k))
    return rule.isNull(), rule


def quality(df: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, list[Rule]]:
    """The kept columns plus COUNTS, OTHER, base_failed, kept and rule, and the rules.

    Texts that are null, empty or blank have no word, fail the base rules and aren't kept. Repeated rows each get a row, an empty
    table gives none, texts of any length are read whole. Without labels there are no rules and the base rules decide. A kept
    column named as a result comes out as input_<name>.
    """
    rules = fitted(df, labels, text, sample)
    stays, rule = verdict(rules)
    return with_statistics(df, keep, text).withColumns({"base_failed": base_failed(), "kept": stays, "rule": rule}), rules
