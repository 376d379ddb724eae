"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

For a prefix w of a pre-split piece, the encoding ends in the one token t for which the encoding of the rest ends in a token
that may stand before t (the pair encodes to itself). So last[i] and count[i] = count[i - len(t)] + 1 follow from shorter
prefixes, and one pass gives the count at every position. A text's counts are stored as one signed byte per character, the
change at that character; sums answer how many tokens a prefix has and where a budget ends, without encoding again.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import SPACE, UNIT
from .common import arrow_map, fields, kept, texts_of

VOCABULARY = "byte_bpe_50k.json"
#: Keys up to so many characters are remembered, and so many of them.
SHORT, REMEMBERED = 256, 1_000_000
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in said["added_tokens"]]
        #: Numbers in order of age: single bytes first, then each merge's result.
        self.number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for m in said["model"]["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            pair = (self.number[a], self.number[b])
            if a + b not in self.number:
                self.number[a + b] = len(self.halves)
                self.halves.append(pair)
            self.joined.setdefault(pair, self.number[a + b])
        #: Only tokens that encode to themselves can stand in an encoding.
        self.number = {t: n for t, n in self.number.items() if n < 256 or self.stands(*self.halves[n], n)}
        #: Each token's number, and None for what is only the end of a token.
        self.ends: dict[bytes, int | None] = {t[k:]: None for t in self.number for k in range(len(t))} | self.number
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.leading = regex.compile(f"[{SPACE}]*")
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.agree: dict[tuple[int, int], bool] = {}
        self.pieces = _Remembered(lambda p: _signed([0, *self.piece(p)]))
        self.units = _Remembered(self.unit_changes)

    def stands(self, left: int, right: int, itself: int) -> bool:
        """No merge older than the token itself crosses the seam between its halves."""
        return self.seam_holds(left, right, itself)

    def seam_holds(self, a: int, b: int, until: int) -> bool:
        """True if a and b, encoded together, don't join across the seam by a merge older than until.

        The merges run from old to new. Seen from the end, the younger of the two tokens at the seam is the last that was
        made; undo it, and look whether the halves that then meet would have joined before.
        """
        halves = self.halves
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < until:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                until, a = a, halves[a][1]
            else:
                until, b = b + 1, halves[b][0]

    def may_follow(self, a: int, b: int) -> bool:
        if (known := self.agree.get((a, b))) is None:
            if len(self.agree) >= 4 * REMEMBERED:
                self.agree.clear()
            known = self.agree[a, b] = self.seam_holds(a, b, 1 << 60)
        return known

    def piece(self, piece: str) -> list[int]:
        """Counts after each character of one pre-split piece."""
        raw = piece.encode()
        agree, ends = self.agree, self.ends
        last, count = [-1], [0]
        for i in range(1, len(raw) + 1):
            j, found = i - 1, []
            while j >= 0 and (part := raw[j:i]) in ends:  # all tokens that end here, by growing length
                if (token := ends[part]) is not None:
                    found.append((j, token))
                j -= 1
            for j, token in reversed(found):
                if j:
                    fits = agree.get((last[j], token))
                    if not (self.may_follow(last[j], token) if fits is None else fits):
                        continue
                last.append(token)
                count.append(count[j] + 1)
                break
        if len(raw) == len(piece):
            out = count[1:]
        else:
            out, at = [], 0
            for c in piece:
                at += len(c.encode())
                out.append(count[at])
        if piece in CONTRACTIONS:  # a prefix of these is split into the apostrophe and letters
            out[1] = self.piece("'")[0] + self.piece(piece[1])[0]
        return out

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit; words with a mark at the end, the usual case, need no pattern."""
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():
            return [unit]
        if body[:-1].isalpha() and body[-1] in ".,;:!?":
            return [unit[:-1], body[-1]]
        return self.pattern.findall(unit)

    def unit(self, unit: str) -> list[int]:
        """Counts after each character of a white-space run and the run that follows it."""
        return np.cumsum(np.frombuffer(self.unit_changes(unit), np.int8), dtype=np.int64).tolist()

    def unit_changes(self, unit: str) -> bytes:
        steps = b"".join(map(self.pieces.__getitem__, self.split(unit)))
        spaces = self.leading.match(unit).end() if unit[1:2].isspace() else 0
        if spaces > 1 and spaces < len(unit):  # cut inside or right after the white space, all of it is one piece
            counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64).tolist()
            counts[:spaces] = self.piece(unit[:spaces])
            steps = _signed([0, *counts])
        return steps

    def changes(self, text: str) -> bytes:
        """The change in the count at each character, as signed bytes; special strings are one token, as the library has them."""
        if self.cuts is None or not any(s in text for s in self.special):
            return b"".join(map(self.units.__getitem__, UNIT.findall(text)))
        out: list[bytes] = []
        tail = ""
        for k, part in enumerate(self.cuts.split(text)):
            if k % 2:  # a special string: until it is complete it is ordinary text after what stands before
                counts = self.unit(tail + part[:-1])[len(tail) :]
                base = self.unit(tail)[-1] if tail else 0
                out.append(_signed([base, *counts, base + 1]))
                tail = ""
            else:
                found = UNIT.findall(part)
                tail = found[-1] if found else ""
                out += map(self.units.__getitem__, found)
        return b"".join(out)


def _signed(counts: list[int]) -> bytes:
    steps = [b - a for a, b in zip(counts, counts[1:], strict=False)]
    if steps and (max(steps) > 127 or min(steps) < -128):
        raise ValueError("a change in the count doesn't fit into a byte")
    return bytes([s & 255 for s in steps])


class _Remembered(dict):
    """What a function gives for short keys, for so many spellings; then it starts over."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        steps = self.make(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = steps
        return steps


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, budget: int = 512, changes: bool = True) -> DataFrame:
    """The kept columns plus n_bytes, n_tokens, over_limit (more tokens than the budget), fit_chars and, if asked for, changes.

    changes holds a signed byte per character: their sum up to a position is the exact token count of that prefix.
    fit_chars is the length in characters of the longest prefix within the budget. Null texts count as empty (0, 0, false, 0).
    """
    path = path or public_tokenizers.path(VOCABULARY)
    chosen = df.select(*kept(df, keep, "n_bytes", "n_tokens", "over_limit", "fit_chars", "changes"), df[text].alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n_bytes, n_tokens, over, fit, raw = [], [], [], [], []
            for t in texts_of(batch, "__text"):
                steps = c.changes(t)
                counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
                total = int(counts[-1]) if counts.size else 0
                within = np.flatnonzero(counts <= budget) if total > budget else None
                n_bytes.append(len(t.encode()))
                n_tokens.append(total)
                over.append(total > budget)
                fit.append(len(t) if within is None else int(within[-1]) + 1 if within.size else 0)
                raw.append(steps if changes else None)
            out = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())] + [pa.array(raw, pa.binary())] * changes
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit", "fit_chars", *["changes"] * changes])

    schema = ", ".join([*fields(chosen.schema)[:-1], "n_bytes long", "n_tokens long", "over_limit boolean", "fit_chars long"] + ["changes binary"] * changes)
    return arrow_map(chosen, rows, schema)


def count_at(changes: bytes, characters: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(changes, np.int8)[:characters].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most budget tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if within.size else 0
