"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from corpusloom.llm.common import lower_words

#: words in a shingle
WIDTH = 5
#: odd multipliers of the mixing steps, one for each word of a shingle
_MIX = [np.uint64(xxhash.xxh3_64_intdigest(bytes([i])) | 1) for i in range(WIDTH)]
_SHIFT = np.uint64(29)


class Hashes:
    """Word to 64-bit hash. None is remembered, as hashing a word anew takes half the time of a look into a large dict."""

    __getitem__ = staticmethod(xxhash.xxh3_64_intdigest)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers of x; numpy's own ``unique`` hashes before it sorts and takes several times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_set(text: str | None, hashes: Hashes) -> np.ndarray:
    """Distinct shingles of WIDTH words, sorted; with fewer words the whole sequence as one; none without words.

    Two shingles share a hash with a probability of 2**-64.
    """
    found = lower_words(text)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(h) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64) if len(h) else h
    n = len(h) - WIDTH + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        mixed = (mixed ^ h[i : i + n]) * _MIX[i]
        mixed ^= mixed >> _SHIFT
    return distinct(mixed)
