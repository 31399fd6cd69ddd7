"""Words of many texts as numpy arrays: spans in the UTF-8 bytes and hashes of any span.

By default texts are lower-cased and a word is a run of ASCII letters and of bytes beyond ASCII;
all else parts words, so `idiot,` and `IDIOT%%%` hold the same word. With plain=True only A-Z are
lower-cased and only the white space 0x20, 0x09-0x0D parts words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[9:14] = _NOT_SPACE[32] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """Powers of the base (k = 0) or its inverse (k = 1) modulo 2^64."""
    if len(_powers[k]) < n:
        base = _BASE if k == 0 else pow(_BASE, -1, 1 << 64)
        row = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        row[0] = 1
        _powers[k] = np.cumprod(row)
    return _powers[k][:n]


class Words:
    """data: all bytes; starts, ends: of each word; first: of each text, its first word (one more at the end)."""

    def __init__(self, texts: list[str], plain: bool = False) -> None:
        raw = [(x if plain else x.lower()).encode("utf-8", "surrogatepass") for x in texts]
        joined = b"\n".join(raw) + b"\n"
        self.data = np.frombuffer(joined.translate(_LOWER) if plain else joined, dtype=np.uint8)
        letter = (_NOT_SPACE if plain else _LETTER)[self.data]
        edge = np.flatnonzero(np.diff(letter, prepend=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.text_at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.text_at)
        self._sum: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal bytes have equal ones wherever they stand."""
        if self._sum is None:
            terms = self.data * _power(0, len(self.data))
            self._sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        x = (self._sum[ends] - self._sum[starts]) * _power(1, len(self.data) + 1)[starts]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def buckets(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return ((hashes + np.uint64(salt)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - bits)).astype(np.int64)


_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def terms(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8, list by list.

    A list holds the words of about `most` bytes, so a very long text never becomes one list.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    start = 0
    while start < len(raw):
        gap = _GAP.search(raw, start + most)
        end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw, start, end)
        start = end
