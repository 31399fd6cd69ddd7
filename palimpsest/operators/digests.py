"""md5 of many short texts `rep:pair` at a time: one block of 64 bytes each, in arrays."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Last digits that vary within an array.
WIDTH = 4
#: By width: the digits of 0, 1, ... with leading zeros, as a little-endian word.
_DIGITS = [None, *(sum((np.arange(10**w, dtype=np.uint32) // 10 ** (w - 1 - i) % 10 + 48) << 8 * i for i in range(w)).astype(np.uint32) for w in range(1, WIDTH + 1))]


def _runs(first: int, last: int) -> Iterator[tuple[str, int, int, int]]:
    """Numbers first..last-1 in runs of equal length that share all but `width` digits: (those, width, low, high)."""
    while first < last:
        width = min(WIDTH, len(str(first)))
        head, low = divmod(first, 10**width) if first >= 10**WIDTH else (0, first)
        high = min(10**width, low + last - first)
        yield str(head) if head else "", width, low, high
        first += high - low


def _digests(head: bytes, width: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """The four words of md5 of head followed by low..high-1 in `width` digits."""
    n = len(head)
    block = bytearray(64)
    block[:n] = head
    block[n + width] = 0x80
    block[56:] = (8 * (n + width)).to_bytes(8, "little")
    fixed, tails = struct.unpack("<16I", block), _DIGITS[width][low:high]
    at, shift = n // 4, 8 * (n % 4)
    varied = {at: tails << np.uint32(shift) if shift else tails}
    if shift and n % 4 + width > 4:
        varied[at + 1] = tails >> np.uint32(32 - shift)
    a, b, c, d = (np.full(high - low, x, np.uint32) for x in _START)
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = _WORD[i]
        f += a
        f += np.uint32((_ADDED[i] + fixed[word]) & 0xFFFFFFFF)
        if word in varied:  # those bytes of the fixed word are zero
            f += varied[word]
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=a)
        f >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return tuple(x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True))


def _sixty(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number that the first 15 hexadecimal digits of two words are."""
    return left.byteswap().astype(np.uint64) << np.uint64(28) | (right.byteswap() >> np.uint32(4)).astype(np.uint64)


def drawn(rep: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of md5(rep:pair) for pairs first..last-1 both numbers of 60 bits (first and second half), in arrays: (their first pair, numbers, numbers)."""
    for head, width, low, high in _runs(first, last):
        a, b, c, d = _digests(f"{rep}:{head}".encode(), width, low, high)
        yield first, _sixty(a, b), _sixty(c, d)
        first += high - low


def remainders(numbers: np.ndarray, n: int) -> np.ndarray:
    """numbers % n: numpy divides by one number far faster than it takes remainders."""
    return (numbers - numbers // np.uint64(n) * np.uint64(n)).astype(np.int64)
