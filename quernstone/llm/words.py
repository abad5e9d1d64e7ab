"""Hashed words and word shingles of a batch of texts, over its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = _BYTE[_FOLD]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each text begins (and the last one ends); null as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and how many words come before each text."""
    word = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = True
    begins[1:-1] = ~word[:-1]
    begins[at] = True
    begins = begins[:-1] & word
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    own = np.flatnonzero(word)
    number = np.cumsum(begins)[own] - 1
    place = own - first[number]
    values = _BYTE[data[own]] * powers(int(place.max()) + 1)[place]
    sums = np.add.reduceat(values, np.searchsorted(own, first))
    lengths = np.bincount(number)
    return mix(sums + lengths.astype(np.uint64) * _U(0x2545F4914F6CDD1D)), np.searchsorted(first, at)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text with fewer words has its whole sequence as one."""
    data, at = text_bytes(column)
    words, before = word_hashes(data, at)
    out = []
    if len(words) >= size:
        grams = words[: len(words) - size + 1].copy()
        for i in range(1, size):
            grams = mix(grams, i) + words[i : len(words) - size + 1 + i]
        grams = mix(grams, size)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif n:
            x = words[a : a + 1].copy()
            for i in range(1, n):
                x = mix(x, i) + words[a + i : a + i + 1]
            out.append(mix(x, 100 + n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
