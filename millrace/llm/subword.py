"""Averaged subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

A word's vector is the mean of the vectors of its spelling and its character n-grams, hashed to a fixed number of buckets; a
bag's vector is the mean over its words; a softmax over a linear map of it gives class probabilities. Embeddings and map are
trained jointly. Since everything before the softmax is linear, a trained model is kept as a class score for each bucket.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np

NOT_WORD = re.compile(r"[\W_]+")


def normal(word: str) -> str:
    """Letters and digits of a word, in lower case."""
    return word.lower() if word.isalnum() else NOT_WORD.sub("", word.lower())


def hashed(word: str, buckets: int, least: int = 3, most: int = 5) -> list[int]:
    """Buckets of a word (as normal() gives it) and its n-grams; empty for none."""
    if not word:
        return []
    raw = f"<{word}>"
    if raw.isascii():  # a byte for each character: cut the bytes
        b, crc = raw.encode(), zlib.crc32
        return [crc(b) % buckets, *[crc(b[i : i + n]) % buckets for n in range(least, most + 1) for i in range(len(b) - n + 1)]]
    grams = [raw, *(raw[i : i + n] for n in range(least, most + 1) for i in range(len(raw) - n + 1))]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


@dataclass
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    epochs: int = 4
    batch: int = 64
    rate: float = 0.5
    seed: int = 7


class Bags:
    """Bags of words as numbers of words, and each word's buckets once; both in compressed rows."""

    def __init__(self, bags: list[list[str]], buckets: int):
        known: dict[str, int] = {}
        grams: list[np.ndarray] = []
        words, starts = array("i"), [0]
        for bag in bags:
            for w in bag:
                if (k := known.get(w)) is None:
                    h = hashed(normal(w), buckets)
                    k = known[w] = len(grams) if h else -1
                    if h:
                        grams.append(np.array(h, dtype=np.int32))
                if k >= 0:
                    words.append(k)
            starts.append(len(words))
        self.words, self.starts = np.frombuffer(words, dtype=np.int32) if words else np.zeros(0, dtype=np.int32), np.array(starts)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.int32)
        self.gram_starts = np.concatenate([[0], np.cumsum([len(g) for g in grams], dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket numbers of the bags' words, weights that average n-grams and words, and positions in rows."""
        size = self.starts[rows + 1] - self.starts[rows]
        row = np.repeat(np.arange(len(rows)), size)
        word = self.words[_ranges(self.starts[rows], size)]
        inner = self.gram_starts[word + 1] - self.gram_starts[word]
        weight = (1 / (np.maximum(size, 1)[row] * inner)).astype(np.float32)
        return self.grams[_ranges(self.gram_starts[word], inner)], np.repeat(weight, inner), np.repeat(row, inner)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the starts, so many each."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Model:
    """scores[b, k]: what bucket b adds to the logit of class k when it is all of a bag."""

    def __init__(self, classes: list, scores: np.ndarray, bias: np.ndarray):
        self.classes, self.scores, self.bias = classes, scores, bias

    def logits(self, bags: Bags, at_once: int = 2048) -> np.ndarray:
        out = []
        for lo in range(0, len(bags), at_once):
            rows = np.arange(lo, min(lo + at_once, len(bags)))
            ids, weights, row = bags.of(rows)
            out.append(np.stack([np.bincount(row, self.scores[ids, k] * weights, minlength=len(rows)) for k in range(len(self.classes))], axis=1))
        return np.concatenate(out) + self.bias if out else np.zeros((0, len(self.classes)))


class Trainer:
    """Plain mini-batch gradient steps with per-coordinate rates (squared gradients summed up)."""

    def __init__(self, classes: list, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s, self.classes, self.rng = s, classes, rng
        k = len(classes)
        self.e = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
        self.w = rng.normal(0, 1.0, (s.dim, k)).astype(np.float32)
        self.b = np.zeros(k, dtype=np.float32)
        self.ge, self.gw, self.gb = np.full_like(self.e, 1e-8), np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)

    def epoch(self, bags: Bags, y: np.ndarray, weight: np.ndarray | None = None) -> float:
        order, loss = self.rng.permutation(len(bags)), 0.0
        for lo in range(0, len(order), self.s.batch):
            loss += self.step(bags, order[lo : lo + self.s.batch], y, weight)
        return loss / max(1, len(order))

    def step(self, bags: Bags, rows: np.ndarray, y: np.ndarray, weight: np.ndarray | None) -> float:
        ids, share, row = bags.of(rows)
        n, d = len(rows), self.s.dim
        touched, place = np.unique(ids, return_inverse=True)
        e = self.e[touched]
        h = np.stack([np.bincount(row, e[place, j] * share, minlength=n) for j in range(d)], axis=1)
        z = h @ self.w + self.b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        target = y[rows]
        loss = -np.log(np.maximum(p[np.arange(n), target], 1e-12))
        g = p
        g[np.arange(n), target] -= 1
        if weight is not None:
            g *= weight[rows][:, None]
            loss *= weight[rows]
        g /= n
        gh = g @ self.w.T
        ge = np.stack([np.bincount(place, gh[row, j] * share, minlength=len(touched)) for j in range(d)], axis=1).astype(np.float32)
        gw, gb = (h.T @ g).astype(np.float32), g.sum(axis=0).astype(np.float32)
        self.ge[touched] += ge * ge
        self.e[touched] -= self.s.rate * ge / np.sqrt(self.ge[touched])
        for x, gx, sx in ((self.w, gw, self.gw), (self.b, gb, self.gb)):
            sx += gx * gx
            x -= 0.1 * self.s.rate * gx / np.sqrt(sx)
        return float(loss.sum())

    def model(self) -> Model:
        return Model(self.classes, (self.e @ self.w).astype(np.float32), self.b.astype(np.float32))


class Scorer:
    """Class scores of words, remembered by spelling; for one worker."""

    REMEMBERED = 1_000_000

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.table = np.zeros((4096, len(self.model.classes)), dtype=np.float32)
        #: Row 0 stands for what holds no letter or digit.
        self.spelt: dict[str, int] = {}
        self.known: dict[str, int] = {"": 0}
        self.n = 1

    def add(self, words: list[str]) -> None:
        """Scores of new spellings, all at once."""
        grams, sizes = array("i"), []
        for w in words:
            key = normal(w)
            if (place := self.known.get(key)) is None:
                h = hashed(key, len(self.model.scores))
                grams.extend(h)
                sizes.append(len(h))
                place = self.known[key] = self.n + len(sizes) - 1
            self.spelt[w] = place
        if sizes:
            while self.n + len(sizes) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            starts = np.cumsum([0, *sizes[:-1]])
            total = np.add.reduceat(self.model.scores[np.frombuffer(grams, dtype=np.int32)], starts)
            self.table[self.n : self.n + len(sizes)] = total / np.array(sizes)[:, None]
            self.n += len(sizes)

    def words(self, text: str) -> np.ndarray:
        """Scores of each word of the whole text, in order (words x classes)."""
        if len(self.spelt) >= self.REMEMBERED:
            self.forget()
        split = text.split()
        if new := [w for w in set(split) if w not in self.spelt]:
            self.add(new)
        at = np.fromiter(map(self.spelt.__getitem__, split), dtype=np.int64, count=len(split))
        return self.table[at[at > 0]]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)
