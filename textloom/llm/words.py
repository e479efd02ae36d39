"""Whole texts as byte arrays: words, word hashes and shingles without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased, nothing else is changed. Texts are read in
windows cut between words, so memory follows the window and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
SHINGLE = 5
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def windows(data: np.ndarray, offsets: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Consecutive spans of about ``most`` bytes that end at a row's end or at a blank."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + most, n)
        if end < n:
            row_end = offsets[np.searchsorted(offsets, end, "right") - 1]
            blanks = np.flatnonzero(_BLANK[data[start:end]])
            cut = max(row_end, start + blanks[-1] + 1 if len(blanks) else 0)
            if cut <= start:  # one word longer than a window
                step = end
                while step < n:
                    found = np.flatnonzero(_BLANK[data[step : step + most]])
                    if len(found):
                        step += int(found[0])
                        break
                    step = min(step + most, n)
                cut = min(step, offsets[np.searchsorted(offsets, start, "right")])
            end = int(cut)
        yield start, end
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of ``data[start:end]``, relative to ``start``."""
    inside = ~_BLANK[data[start:end]]
    brk = np.zeros(end - start + 1, bool)
    edges = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, end, "right")] - start
    brk[edges] = True
    brk[0] = brk[-1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | brk[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | brk[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_counts(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    total = np.zeros(len(column), np.int64)
    for start, end in windows(data, offsets):
        begins, _ = word_spans(data, offsets, start, end)
        rows = np.searchsorted(offsets, begins + start, "right") - 1
        total += np.bincount(rows, minlength=len(total))
    return total


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, WINDOW + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * WINDOW:
            _POWERS[name] = have
    return have


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offsets of each row's words.

    A word's hash is a difference of prefix sums of byte * base^position, divided by base^begin modulo 2^64.
    """
    data, offsets = utf8(column)
    hashes, rows = [], np.zeros(len(column), np.int64)
    inverse = pow(_BASE, -1, 1 << 64)
    for start, end in windows(data, offsets):
        begins, ends = word_spans(data, offsets, start, end)
        if not len(begins):
            continue
        n = end - start
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data[start:end]].astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n)[:n], out=sums[1:])
        value = (sums[ends] - sums[begins]) * _powers("down", inverse, n)[begins]
        hashes.append(mix64(value + (ends - begins).astype(np.uint64)))
        rows += np.bincount(np.searchsorted(offsets, begins + start, "right") - 1, minlength=len(rows))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return flat, np.r_[0, np.cumsum(rows)]


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words of one row; a row of fewer words is one run of all it has."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(_BASE) + words[k : len(words) - size + 1 + k])
    return out
