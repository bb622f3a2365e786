"""Words and word grams of whole Arrow text columns, as numpy arrays.

A text column arrives as one byte buffer; it is cut into slices of about ``SLICE`` bytes (a longer text stays whole) and
every step works on a slice at once, so memory follows ``SLICE`` and the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """True for the bytes within ``spans`` (inclusive)."""
    out = np.zeros(256, dtype=bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Everything but space, tab, line breaks, vertical tab and form feed.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all that is not ASCII.
LETTERS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Words:
    """Words of the rows ``first`` to ``first + rows``; ``row`` counts from ``first``."""

    first: int
    rows: int
    buffer: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def count(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def place(self) -> np.ndarray:
        """Number of the word within its text."""
        before = np.concatenate(([0], np.cumsum(self.count())))
        return np.arange(len(self.row)) - before[self.row]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of the rows within the bytes); null counts as the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, j - i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(column: pa.Array, is_word: np.ndarray) -> Iterator[Words]:
    """The words of each slice; A-Z are lower-cased first."""
    for first, rows, raw, at in slices(column):
        low = LOWER[raw]
        yield runs(first, rows, low, raw, at, is_word[low])


def runs(first: int, rows: int, low: np.ndarray, raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of one kind within a row; ``kind`` has a number or truth value a byte, zero belongs to no run."""
    edge = at[:-1][at[:-1] < len(kind)]
    opens = kind != 0
    opens[1:] &= kind[1:] != kind[:-1]
    opens[edge] = kind[edge] != 0
    closes = kind != 0
    closes[:-1] &= kind[:-1] != kind[1:]
    edge = edge[edge > 0] - 1
    closes[edge] = kind[edge] != 0
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(first, rows, low, raw, start, end, np.searchsorted(at, start, "right") - 1)


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SLICE)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(w: Words, buffer: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all words of a slice (of ``buffer`` instead of the lower-cased bytes, if given): running sums over pieces of about ``SLICE`` bytes,
    so that memory beyond one number a word follows ``SLICE``, whatever the length of a text or a word."""
    buffer = w.buffer if buffer is None else buffer
    out = np.empty(len(w.start), dtype=np.uint64)
    size = (w.end - w.start).astype(np.uint64)
    i = 0
    while i < len(w.start):
        base = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, base + SLICE, "right")))
        if w.end[i] - base > SLICE:
            out[i] = _long_sum(buffer[base : w.end[i]])
        else:
            part = buffer[base : w.end[j - 1]]
            up, down = power(SLICE + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            start = w.start[i:j] - base
            out[i:j] = (total[w.end[i:j] - base] - total[start]) * down[start]
        i = j
    return mix(out + size)


def _long_sum(part: np.ndarray) -> np.uint64:
    """What the running sums give for one word that is longer than a slice."""
    up, total = power(SLICE + 1)[0], 0
    for at in range(0, len(part), SLICE):
        piece = part[at : at + SLICE].astype(np.uint64) + np.uint64(1)
        total += int((piece * up[: len(piece)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return np.uint64(total & ((1 << 64) - 1))


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all runs of ``k`` words that stay within one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _GRAM + hashes[i : i + n]
    keep = np.flatnonzero(row[:n] == row[k - 1 :])
    return keep, mix(out[keep])


def hash_words(tokens: list[str]) -> np.ndarray:
    """The same hashes for a list of single words."""
    if not tokens:
        return np.zeros(0, np.uint64)
    return np.concatenate([word_hashes(w) for w in words(pa.array(tokens), byte_class((1, 255)))])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
