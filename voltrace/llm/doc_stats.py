"""Statistics of one text, exact and in a vector for the quality model."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters that count as symbols (fixed values of the rule).
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "exclaims", "line_words", "bars", "top_word")
#: Direction in which the score may move with a feature: -1 never up, 0 free.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, -1, 0, -1, -1)

_SPACE = np.array([9, 10, 11, 12, 13, 32])
_RNG = np.random.default_rng(20240101)
_POWERS = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(ids: list[int]) -> int:
    """Words in 8-word windows that occur twice or more, the first included."""
    m = len(ids) - WINDOW + 1
    if m < 2:
        return 0
    x = np.asarray(ids, np.uint64)
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        h += x[k : k + m] * _POWERS[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twin = np.zeros(m, bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    starts = np.flatnonzero(twin)
    windows = [tuple(ids[i : i + WINDOW]) for i in starts.tolist()]  # equal hashes are held against the words themselves
    often = Counter(windows)
    cover = np.zeros(len(ids) + 1, np.int64)
    for i, w in zip(starts.tolist(), windows, strict=True):
        if often[w] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The exact counts, and the features. Null counts as a text without words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(words)
    word_chars = len(text) - int(hist[_SPACE].sum())
    n_symbols = int(hist[list(SYMBOLS)].sum())
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    seen: set[bytes] = set()
    n_lines = dup = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(ids) if len(number) < n else 0
    w, c = max(1, n), max(1, word_chars)
    top = int(np.bincount(np.asarray(ids, np.int64)).max()) if n else 0
    return [n, word_chars, n_symbols, dup, repeat], [
        float(np.log1p(n)),
        word_chars / w,
        n_symbols / c,
        dup / max(1, n_lines),
        repeat / w,
        len(number) / w,
        int(hist[65:91].sum()) / c,
        int(hist[48:58].sum()) / c,
        int(hist[[33, 44, 46, 58, 59, 63]].sum()) / c,
        int(hist[33]) / c,
        n / max(1, n_lines),
        int(hist[124]) / w,
        top / w,
    ]


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words
