"""Language identification by averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fields, held_out, kept, texts_of
from .sample import spread_ids
from .subword import Bags, Model, Scorer, Settings, Trainer, softmax

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: At most so many labelled rows are fitted on, of at most so many characters each.
SAMPLE, LONGEST = 1_500, 30_000
#: The share of right predictions on rows kept apart that rejection may cost.
COST = 0.01
SETTINGS = Settings(buckets=1 << 16, epochs=4, batch=32)


@dataclass
class Identifier:
    model: Model
    #: Probabilities are taken at this temperature and accepted from this threshold on; both are fitted on rows kept apart.
    temperature: float
    threshold: float


def fit(texts: list[str], langs: list[str], s: Settings = SETTINGS) -> Identifier | None:
    """None if there is no labelled row. Every tenth row is kept apart for the temperature and the threshold."""
    if not texts:
        return None
    classes = sorted(set(langs))
    y = np.array([classes.index(v) for v in langs])
    apart = np.arange(len(texts)) % 10 == 9
    train = [t.split() for t, a in zip(texts, apart, strict=True) if not a]
    bags = Bags(train, s.buckets)
    t = Trainer(classes, s)
    for _ in range(s.epochs):
        t.epoch(bags, y[~apart])
    model = t.model()
    if not apart.any():
        return Identifier(model, 1.0, 0.0)
    z = model.logits(Bags([x.split() for x, a in zip(texts, apart, strict=True) if a], s.buckets))
    loss = lambda k: -np.log(np.maximum(softmax(z / k)[np.arange(len(z)), y[apart]], 1e-12)).mean()
    temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0), key=loss)
    p = softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[apart]])
    return Identifier(model, temperature, float(right[int(COST * len(right))]) if right.size else 0.0)


def training_rows(df: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """Texts and languages outside the held-out fifth, at most sample of them (or one of each language), spread over the languages; doc_id is only used to pick rows."""
    usable = df.select("doc_id", df[text].alias("__text"), df[lang].alias("__lang")).where("doc_id is not null and __lang is not null and __text is not null").where(~held_out())
    ids = spread_ids(usable.select("doc_id", "__lang"), "doc_id", "__lang", sample).groupBy("doc_id", "__lang").agg(F.min("rank").alias("rank")).collect()
    most = max(sample, len({r[1] for r in ids}))
    ids = df.sparkSession.createDataFrame(ids, "doc_id " + df.schema["doc_id"].dataType.simpleString() + ", __lang string, rank int")
    rows = (
        usable.where(F.char_length("__text") <= longest)
        .join(F.broadcast(ids), ["doc_id", "__lang"])
        .select("__text", "__lang", F.xxhash64("doc_id").alias("hash"), "rank")
        .orderBy("rank", "hash", "__text", "__lang")
        .limit(most)
        .collect()
    )
    rows = [r for r in sorted(rows, key=lambda r: (r[2], r[0], r[1])) if LETTER.search(r[0])]
    return [r[0] for r in rows], [r[1] for r in rows]


def identify(df: DataFrame, fitted: Identifier | None, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns plus lang_pred, score and accepted (the score reaches the calibrated threshold).

    Null texts and texts without a letter (category L) are UNKNOWN with score 0, as is everything when nothing was learned. Of
    equally likely languages the first by name is predicted; a text without any word has an empty bag. Repeated rows each get a row, an empty table gives none, and texts of
    any length are read whole. A kept column named as a result comes out as input_<name>.
    """
    chosen = df.select(*kept(df, keep, "lang_pred", "score", "accepted"), df[text].alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # buckets x languages floats: a fixed size
    state: dict[int, Scorer] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        scorer = state.setdefault(0, Scorer(f.model)) if f else None
        for batch in batches:
            lang, score = [], []
            for t in texts_of(batch, "__text"):
                if f is None or not LETTER.search(t):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                words = scorer.words(t)  # none if Python's tables know none of its letters: the bias alone decides
                p = softmax((words.sum(axis=0, dtype=np.float64) / max(1, len(words)) + f.model.bias) / f.temperature)
                lang.append(f.model.classes[int(p.argmax())])
                score.append(float(p.max()))
            yes = [x != UNKNOWN and p >= f.threshold for x, p in zip(lang, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(yes, pa.bool_())], [*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    return arrow_map(chosen, rows, ", ".join([*fields(chosen.schema)[:-1], "lang_pred string", "score double", "accepted boolean"]))


def language(df: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows outside the held-out fifth, then identify every row of df."""
    return identify(df, fit(*training_rows(df, text, lang)), keep, text)
