"""Hashed word shingles, segment keys and bitmaps of one text; pure numpy."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import xxhash

#: Odd multipliers, one for each word of a shingle (digits of the golden ratio and of primes' roots; any odd numbers do).
_MUL = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, one hash of all of them; without words, empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([cache[w] for w in words], dtype=np.uint64)
    if len(h) < n:
        total = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            total += h[k : k + 1] * _MUL[k % len(_MUL)]
        return finish(total)
    m = len(h) - n + 1
    total = h[:m] * _MUL[0]
    for k in range(1, n):
        total += h[k : k + m] * _MUL[k % len(_MUL)] + np.uint64(k // len(_MUL))
    return np.unique(finish(total))


def bits_for(size: int) -> int:
    return max(64, 1 << (4 * size - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """Hashed bitmap of a set: four to eight bits a token, a power of two; low bits decide, so halves fold together."""
    bits = np.zeros(bits_for(max(1, len(tokens))), np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to n of them."""
    while len(words) > n:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def overlap_bound(size_a: int, a: np.ndarray, size_b: int, b: np.ndarray) -> int:
    """Most tokens that two sets can share: each bit set in one bitmap alone stands for a token of that set alone."""
    n = min(len(a), len(b))
    a, b = fold(a, n), fold(b, n)
    return min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))


def enough(overlap: int, size_a: int, size_b: int, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    return (100 + percent) * overlap >= percent * (size_a + size_b)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


@lru_cache(maxsize=64)
def bands(percent: int, limit: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands; each band spans a factor of 1.5, so partners lie in the same or the next band (percent > 67)."""
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return ends


def most_different(size_a: int, size_b: int, percent: int) -> int:
    """Most tokens in just one of two linked sets of these sizes."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def segment_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two linked sets share at least one.

    Tile b serves pairs whose smaller set lies in band b. It cuts the hash range into S
    segments. Linked sets differ in at most k tokens, so at least S - k segments agree
    wholly. A set of which no partner can differ in more than k tokens emits k + 1
    segments: those first in one order of segment contents (most tokens first) that is
    the same for all sets. The first agreeing segment in this order is emitted by both
    sets, since neither leaves out S - k - 1 or fewer others before leaving it out.
    """
    m = len(tokens)
    if not m:
        return np.zeros(0, np.uint64)
    ends = bands(percent)
    own = bisect_right(ends, m) - 1
    smallest = -(-percent * m // 100)
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(finish(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    out = []
    for b in range(bisect_right(ends, smallest) - 1, own + 1):
        last = ends[b + 1] - 1  # largest size in the band
        segments = (most_different(last, last * 100 // percent, percent) + 1) * 3 // 2
        k = most_different(m, m * 100 // percent if b == own else last, percent)
        cut = (np.arange(segments + 1, dtype=np.float64) * (2.0**64 / segments)).clip(0, 2.0**64 - 2048).astype(np.uint64)
        at = np.searchsorted(tokens, cut)
        at[-1] = m
        count = np.diff(at)
        content = mixed[at[1:]] - mixed[at[:-1]]
        salt = np.uint64((b * 0x9E3779B97F4A7C15 + percent) & (2**64 - 1))
        key = finish(finish(content + salt) + np.arange(segments, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        if k + 1 < segments:
            key = key[np.lexsort((key, -count))[: k + 1]]
        out.append(key)
    return np.concatenate(out)
