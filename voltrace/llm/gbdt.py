"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotone features, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees laid out one after the other; a leaf points to itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x: all trees at once, one level per step."""
        if not len(x):
            return np.zeros(0)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, min_rows: int = 10) -> Forest:
    """Fit to labels y in 0, 1. monotone: -1 scores never rise with the feature, 1 never fall, 0 free."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)
    prior = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(prior / (1 - prior)))
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add() -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(add())
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            k, rows, lo, hi, level = todo.pop()
            own = float(np.clip(g[rows].sum() / (h[rows].sum() + l2), lo, hi))
            value[k] = own * rate
            best = _best_split(binned, cuts, g, h, rows, monotone, l2, min_rows, lo, hi) if level < depth and len(rows) >= 2 * min_rows else None
            if best is None:
                raw[rows] += value[k]
                continue
            j, cut, wl, wr = best
            goes = binned[rows, j] <= cut
            feature[k], threshold[k] = j, float(cuts[j][cut])
            left[k], right[k] = add(), add()
            mid = (wl + wr) / 2
            bl, br = ((lo, hi), (lo, hi)) if not monotone[j] else (((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, mid), (mid, hi)))
            todo += [(left[k], rows[goes], *bl, level + 1), (right[k], rows[~goes], *br, level + 1)]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def _best_split(binned, cuts, g, h, rows, monotone, l2, min_rows, lo, hi):
    gain_least, best = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    now = total_g**2 / (total_h + l2)
    for j in range(binned.shape[1]):
        n_cut = len(cuts[j])
        if not n_cut:
            continue
        b = binned[rows, j]
        gl = np.cumsum(np.bincount(b, g[rows], n_cut + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h[rows], n_cut + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=n_cut + 1))[:-1]
        wl = np.clip(gl / (hl + l2), lo, hi)
        wr = np.clip((total_g - gl) / (total_h - hl + l2), lo, hi)
        gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - now
        ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
        if monotone[j]:
            ok &= (wr - wl) * monotone[j] >= 0
        gain = np.where(ok, gain, -np.inf)
        c = int(np.argmax(gain))
        if gain[c] > gain_least:
            gain_least, best = gain[c], (j, c, float(wl[c]), float(wr[c]))
    return best
