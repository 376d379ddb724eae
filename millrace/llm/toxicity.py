"""Toxicity by averaged subword embeddings under a linear softmax, so that unseen misspellings share n-gram vectors.

Bags are windows of WINDOW words, as a few words in a long text would vanish in its average; a text's score is that of its
worst window, over all of its windows. Training starts with every window under its document's label and goes on with, of the
toxic documents, the worst window alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fields, held_out, kept, texts_of
from .sample import bounded_ids
from .subword import Bags, Model, Scorer, Settings, Trainer, softmax

WINDOW = 16
#: At most so many labelled rows are fitted on, of at most so many characters each.
SAMPLE, LONGEST = 3_000, 30_000
SETTINGS = Settings()


def windows(words: list[str], size: int = WINDOW) -> list[list[str]]:
    """Consecutive windows of a training text; the last holds what is left."""
    return [words[i : i + size] for i in range(0, len(words), size)]


def fit(texts: list[str], toxic: list[int], s: Settings = SETTINGS) -> Model | None:
    """A two-class model (0, 1); None if the sample lacks one of them."""
    if len(set(toxic)) < 2:
        return None
    split, doc = [], []
    for i, t in enumerate(texts):
        for w in windows(t.split()):
            split.append(w)
            doc.append(i)
    bags, doc = Bags(split, s.buckets), np.array(doc)
    y = np.array(toxic)[doc]
    share = (1 / np.sqrt(np.bincount(doc, minlength=len(texts))))[doc]
    share /= share.mean()
    t = Trainer([0, 1], s)
    for _ in range(max(1, s.epochs // 2)):
        t.epoch(bags, y, share)
    for _ in range(s.epochs - s.epochs // 2):
        z = t.model().logits(bags)
        z = z[:, 1] - z[:, 0]
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, z)
        t.epoch(bags, y, np.where(y == 1, np.where(z >= worst[doc], 3.0, 0.0), 1.0))
    return t.model()


def worst_window(scorer: Scorer, text: str, size: int = WINDOW) -> float:
    """Probability of the worst of all windows, each starting one word after the other; texts without words get the bias alone."""
    m = scorer.model
    s = scorer.words(text)
    d = s[:, 1].astype(np.float64) - s[:, 0]
    if not d.size:
        z = 0.0
    elif d.size <= size:
        z = d.mean()
    else:
        c = np.concatenate([[0.0], np.cumsum(d)])
        z = (c[size:] - c[:-size]).max() / size
    return float(softmax(np.array([0.0, z + m.bias[1] - m.bias[0]]))[1])


def training_rows(df: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """Texts and labels outside the held-out fifth, at most sample of them; doc_id is only used to pick and join rows."""
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    ids = bounded_ids(marked, "doc_id", sample)
    rows = (
        df.select("doc_id", df[text].alias("__text"))
        .where(F.col("__text").isNotNull() & (F.char_length("__text") <= longest))
        .join(F.broadcast(ids), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "__text")
        .limit(sample)
        .select("__text", "__toxic")
        .collect()
    )
    return [r[0] for r in rows], [int(r[1] == 1) for r in rows]


def score(df: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns plus score and predicted (1 from 0.5 on). Null and empty texts are scored as texts without words; without a
    model all scores are 0. Repeated rows each get a row, with the same score; an empty table gives none; texts of any length are
    read whole. A kept column named as a result comes out as input_<name>."""
    chosen = df.select(*kept(df, keep, "score", "predicted"), df[text].alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x 2 floats: a fixed size
    state: dict[int, Scorer] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = state.setdefault(0, Scorer(shared.value)) if shared.value else None
        for batch in batches:
            p = [worst_window(scorer, t) if scorer else 0.0 for t in texts_of(batch, "__text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], [*batch.schema.names[:-1], "score", "predicted"])

    return arrow_map(chosen, rows, ", ".join([*fields(chosen.schema)[:-1], "score double", "predicted int"]))


def toxicity(df: DataFrame, labels: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Fit on the labelled rows outside the held-out fifth, then score every row of df."""
    return score(df, fit(*training_rows(df, labels, text)), keep, text)
