"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clipweave.llm.common import text_slices

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))[_LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            full = np.full(n, base, _U)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word.  A-Z are lower-cased; words end at ASCII white space."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def _fold(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    acc = (acc ^ word) * _U(0xD6E8FEB86659FD93)
    return acc ^ (acc >> _U(29))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``k``-word shingles.

    With fewer words the whole sequence is the one shingle; without words (or null) the set is empty.
    """
    with np.errstate(over="ignore"):
        for _, data, offsets in text_slices(texts):
            words, owner = _words(data, offsets)
            bounds = np.searchsorted(owner, np.arange(len(offsets)))
            m = max(0, len(words) - k + 1)
            acc = np.full(m, 0x2545F4914F6CDD1D, _U)
            for j in range(k):
                acc = _fold(acc, words[j : j + m])
            acc = mix(acc)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a >= k:
                    yield np.unique(acc[a : b - k + 1])
                elif b > a:
                    one = np.full(1, 0x2545F4914F6CDD1D, _U)
                    for j in range(a, b):
                        one = _fold(one, words[j : j + 1])
                    yield mix(one)
                else:
                    yield np.zeros(0, _U)
