"""The binary Golay code of length 23: which codewords lie near a word; tables are built from the generator polynomial."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. Codewords are its multiples; any two differ in 7 bits at least, and each word lies within 3 of just one.
POLYNOMIAL = 0b101011100011
LENGTH, CHECK = 23, 11
#: A word has one codeword within REACH bits if its nearest is within 2, else six.
REACH, MOST = 4, 6


def remainder(word: int) -> int:
    for k in range(LENGTH - 1, CHECK - 1, -1):
        if word >> k & 1:
            word ^= POLYNOMIAL << (k - CHECK)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(remainders of the low 12 bits, remainders of the high 11 bits, error patterns by remainder, how many there are).

    The patterns of a remainder are the words of up to REACH bits that have it: what is to be changed in a word to make it a codeword. Padding is 0.
    """
    single = [remainder(1 << k) for k in range(LENGTH)]
    spread = lambda at, n: np.array([np.bitwise_xor.reduce([0, *(single[at + b] for b in range(n) if x >> b & 1)]) for x in range(1 << n)], np.uint32)
    patterns: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(REACH + 1):
        for bits in combinations(range(LENGTH), weight):
            r = 0
            for b in bits:
                r ^= single[b]
            patterns[r].append(sum(1 << b for b in bits))
    count = np.array([len(p) for p in patterns], np.int64)
    return spread(0, 12), spread(12, 11), np.array([p + [0] * (MOST - len(p)) for p in patterns], np.uint32), count


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, valid), both of shape (n, MOST): the 12-bit indices of the codewords within REACH bits of each word.

    Words that differ in 2 bits at most have an index in common: the codeword nearest to the word half way is within 3 of it, so within REACH of both.
    """
    low, high, patterns, count = tables()
    words = words.astype(np.uint32)
    r = low[words & np.uint32(0xFFF)] ^ high[words >> np.uint32(12)]
    codewords = words[:, None] ^ patterns[r]
    return codewords >> np.uint32(CHECK), np.arange(MOST)[None, :] < count[r][:, None]
