"""Words and hashes of word sequences, computed with numpy inside a task's batches.

A word is a run of characters other than blank and \\t to \\r. Hashes have 64 bits and do not depend on the
process or the machine.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_U = np.uint64
#: Odd multipliers of the words' places in a sequence.
_PLACES = [_U(xxhash.xxh3_64_intdigest(f"place {i}") | 1) for i in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all bits (the finaliser of MurmurHash3)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words in UTF-8; lower: with A-Z as a-z."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequence_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` consecutive words; empty if there are fewer."""
    n = len(word_hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    if size <= 8:
        h = word_hashes[:n] * _PLACES[0]
        for i in range(1, size):
            h += word_hashes[i : i + n] * _PLACES[i]
        return mix(h)
    # Long windows: a polynomial of the words' hashes from differences of a running sum.
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = _powers(base, len(word_hashes)), _powers(inverse, len(word_hashes))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word_hashes * down, dtype=np.uint64)))
    return mix((total[size:] - total[:n]) * up[:n])


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1) - 1, _U(base)))))


def shingle_set(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of the shingles; with fewer words, the whole sequence is the only one."""
    if not len(word_hashes):
        return np.empty(0, np.int64)
    if len(word_hashes) < size:
        h = mix((word_hashes * np.array(_PLACES[: len(word_hashes)])).sum(keepdims=True) + _U(len(word_hashes)))
    else:
        h = sequence_hashes(word_hashes, size)
    return np.unique(h.view(np.int64))


def batch_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and each text's number of words."""
    words = [split(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts
