"""Jumping ahead in the Mersenne Twister, so that tasks seed themselves anywhere in one stream of random numbers.

The generator's words are a linear recurrence over GF(2) of degree DEGREE. Its characteristic polynomial is found from one bit of
its output by the Berlekamp-Massey algorithm; x^k modulo that polynomial, by repeated squaring, says which of the first DEGREE
windows of words add up to the window k places further. Polynomials are whole numbers, a bit for each coefficient.
"""

from __future__ import annotations

import functools
import random

import numpy as np

#: Words of the state, degree of the recurrence.
WORDS, DEGREE = 624, 19937


def generator(key: np.ndarray) -> np.random.RandomState:
    """A generator whose next word follows the given window of words."""
    r = np.random.RandomState()
    r.set_state(("MT19937", key, WORDS))
    return r


@functools.lru_cache(maxsize=4)
def opening(seed: int) -> np.ndarray:
    """The first words of the recurrence: the state that Python's random module seeds, and what follows."""
    state = random.Random(seed).getstate()[1]
    r = generator(np.array(state[:-1], dtype=np.uint32))
    out = [r.get_state()[1]]
    while len(out) * WORDS < DEGREE + WORDS:
        r.bytes(4 * WORDS)
        out.append(r.get_state()[1])
    return np.concatenate(out)


@functools.cache
def characteristic() -> int:
    """The polynomial, of degree DEGREE. Any seed's words satisfy it."""
    bits = [b & 1 for b in np.random.RandomState(1).randint(0, 1 << 32, 2 * DEGREE + 64, dtype=np.uint32).tolist()]
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit  # bit i of seen is the output i places ago
        if not (now & seen & ((1 << (length + 1)) - 1)).bit_count() & 1:
            gap += 1
        elif 2 * length <= n:
            now, before, length, gap = now ^ (before << gap), now, n + 1 - length, 1
        else:
            now ^= before << gap
            gap += 1
    if length != DEGREE:
        raise ArithmeticError("the recurrence has another degree")
    return int(f"{now:0{DEGREE + 1}b}"[::-1], 2)  # the connection polynomial read backwards


@functools.cache
def _below() -> tuple[int, tuple[int, ...]]:
    """How far a reduction takes the degree down, and the exponents of the polynomial but for its first."""
    rest = characteristic() ^ (1 << DEGREE)
    return DEGREE - rest.bit_length() + 1, tuple(i for i in range(DEGREE) if rest >> i & 1)


def _reduced(p: int) -> int:
    """p modulo the characteristic polynomial: its upper part is replaced by the few lower terms that equal it."""
    _, terms = _below()
    mask = (1 << DEGREE) - 1
    while high := p >> DEGREE:
        p &= mask
        for t in terms:
            p ^= high << t
    return p


SPREAD = np.array([sum((b >> i & 1) << 2 * i for i in range(8)) for b in range(256)], dtype="<u2")


def power(k: int) -> int:
    """x^k modulo the characteristic polynomial."""
    p = 1
    for bit in f"{k:b}":
        raw = np.frombuffer(p.to_bytes((p.bit_length() + 7) // 8, "little"), dtype=np.uint8)
        p = int.from_bytes(SPREAD[raw].tobytes(), "little")  # a square has the same coefficients, twice as far apart
        p = _reduced(p << (bit == "1"))
    return p


@functools.lru_cache(maxsize=16)
def _window(seed: int, k: int) -> bytes:
    if k < DEGREE:
        return opening(seed)[k : k + WORDS].tobytes()
    p, words = power(k), opening(seed)
    out = np.zeros(WORDS, dtype=np.uint32)
    for i in np.flatnonzero(np.unpackbits(np.frombuffer(p.to_bytes(DEGREE // 8 + 1, "little"), dtype=np.uint8), bitorder="little")):
        out ^= words[i : i + WORDS]
    return out.tobytes()


def after(seed: int, draws: int) -> np.random.RandomState:
    """The generator that Python's random.Random(seed) is after so many calls of random(), which take two words each.
    random_sample() gives the numbers that random() would."""
    return generator(np.frombuffer(_window(seed, 2 * draws), dtype=np.uint32))
