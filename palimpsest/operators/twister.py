"""The standard library's generator, entered at any word of its stream.

The generator is linear over GF(2): J steps are what the polynomial x^J modulo its characteristic
polynomial makes of the state. That polynomial of degree 19937 is found from the stream's own bits,
so nothing is tabulated; powers follow by squaring. Tasks thus begin where they like.
"""

from __future__ import annotations

import functools
import random

import numpy as np

#: Words of the state, and its bits that matter.
WORDS, DEGREE = 624, 19937


def seeded(seed: int) -> np.ndarray:
    """The words from which random.Random(seed) makes its first output."""
    *key, pos = random.Random(seed).getstate()[1]
    if pos != WORDS:
        raise ValueError("the generator has been used")
    return np.array(key, dtype=np.uint32)


def source(key: np.ndarray) -> np.random.MT19937:
    """A generator whose next output is the first after these words."""
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}
    return out


@functools.cache
def characteristic() -> int:
    """The polynomial as a number, bit i for x^i: the shortest recurrence of one bit of the stream (Berlekamp and Massey)."""
    n = 2 * DEGREE
    bits = (source(seeded(1)).random_raw(n) & np.uint64(1)).astype(np.uint8)
    now, before, length, gap = 1, 1, 0, 1
    window = 0  # bit i: the output i steps ago
    for i in range(n):
        window = window << 1 | int(bits[i])
        if (now & window).bit_count() & 1:
            kept = now
            now ^= before << gap
            if 2 * length <= i:
                length, before, gap = i + 1 - length, kept, 1
                continue
        gap += 1
    if length != DEGREE:
        raise RuntimeError("the recurrence of the stream was not found")
    # The recurrence is told backwards: its bit i belongs to x^(length - i).
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


@functools.cache
def _lower_terms() -> tuple[int, ...]:
    low = characteristic() ^ 1 << DEGREE
    return tuple(i for i in range(DEGREE) if low >> i & 1)


def _reduced(p: int) -> int:
    while high := p >> DEGREE:
        p &= (1 << DEGREE) - 1
        for i in _lower_terms():
            p ^= high << i
    return p


def power(steps: int) -> int:
    """x^steps modulo the characteristic polynomial."""
    p = 1
    for bit in bin(steps)[2:] if steps else "":
        p = _reduced(int("0".join(bin(p)[2:]), 2))  # a square has its bits apart
        if bit == "1":
            p = _reduced(p << 1)
    return p


def jumped(key: np.ndarray, steps: int) -> np.ndarray:
    """The words of the state after so many outputs."""
    if not steps:
        return key
    at = np.flatnonzero(np.array(list(bin(power(steps))[:1:-1]), dtype="U1") == "1")
    there, words = source(key), [key]
    while len(words) * WORDS < DEGREE + 2 * WORDS:
        there.random_raw(WORDS)
        words.append(there.state["state"]["key"])
    stream = np.concatenate(words)
    out = np.zeros(WORDS, dtype=np.uint32)
    for part in np.array_split(at, 16):  # a part of the sum at a time
        out ^= np.bitwise_xor.reduce(np.lib.stride_tricks.sliding_window_view(stream, WORDS)[part], axis=0)
    return out


def accepted(there: np.random.MT19937, n: int, words: int) -> np.ndarray:
    """What randrange(n) makes of the next words: of each its highest bits, as many as n has, where they are below n."""
    x = there.random_raw(words) >> np.uint64(32 - n.bit_length())
    return x[x < n].astype(np.int64)
