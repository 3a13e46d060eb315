"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

WIDTH, PART = 5, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BYTE = _EXACT[_LOWER]
_BASE, _INVERSE = 0xE7037ED1A0B428DB, pow(0xE7037ED1A0B428DB, -1, 1 << 64)
_STEP = np.uint64(0x8EBC6AF09C88C6E3)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_EXACT[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the row that each is in. A-Z count as a-z; words are parted by the bytes
    that are a ``gap``: space and 0x09-0x0D.

    More than ``PART`` bytes are read in parts cut at white space or between rows, so that beside the words
    only a part's tables are held.
    """
    found, at = [], 0
    while at < len(data):
        to = min(at + PART, len(data))
        while to < len(data) and not gap[data[to]]:  # a word, or with the next rows', some more bytes
            to += 1
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")]
        rows = np.concatenate(([at], inner, [to]))
        hashes, of = _words(data[at:to], rows - at, gap)
        found.append((hashes, np.searchsorted(offsets, rows[:-1], "right")[of] - 1))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def _words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    solid = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (first[:n] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate((~solid[1:], [True])))) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, end to end; and the offsets of the rows.

    A row of fewer than ``width`` words has its whole sequence as one shingle, a row without words none.
    """
    rows = len(offsets) - 1
    words, of = word_hashes(data, offsets)
    counts = np.bincount(of, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(counts)))
    full = max(0, len(words) - width + 1)
    out = mix64(words[:full] + np.uint64(width)) if full else np.zeros(0, np.uint64)
    for k in range(1, width):
        out = mix64(out * _STEP + words[k : k + full])
    inside = of[:full] == of[width - 1 :] if full else np.zeros(0, bool)
    out, at = out[inside], of[:full][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            x = mix64(words[begin[r] : begin[r] + 1] + np.uint64(counts[r]))
            for w in range(begin[r] + 1, begin[r + 1]):
                x = mix64(x * _STEP + words[w : w + 1])
            own[i] = x[0]
        out, at = np.concatenate((out, own)), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    edges = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=rows))))
    for r in range(rows):
        out[edges[r] : edges[r + 1]].sort()
    if len(out):
        new = np.concatenate(([True], (out[1:] != out[:-1]) | (at[1:] != at[:-1])))
        out, at = out[new], at[new]
    return out, np.concatenate(([0], np.cumsum(np.bincount(at, minlength=rows)))).astype(np.int64)
