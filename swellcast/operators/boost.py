"""Boosted regression trees for one bounded set of rows (a fold of a series).

Squared-error boosting with the regularised split score ``T(G)^2 / (H + lambda)``
(``G`` and ``H`` the sums of gradients and rows, ``T`` the soft threshold by alpha).
A split must gain more than 1e-6; splits above leaves that gain less than gamma are
pruned; a leaf is worth ``-T(G) / (H + lambda)`` times the learning rate. Features
are cut into at most ``bins`` bins of about equal numbers of train rows, or at every
distinct value where there are fewer. A tree sees a random share of the rows and of
the features, from one generator seeded per ensemble and drawn from tree by tree. So
the first k trees of an ensemble *are* the ensemble of k trees: one fit at the
largest count serves all smaller ones.

These helpers run inside a task, over as many rows as a training window has hours;
:mod:`.tuning` spreads the windows, targets and settings over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MIN_GAIN = 1e-6


@dataclass(frozen=True)
class Shape:
    """Everything of a setting but its number of trees."""

    learning_rate: float = 0.1
    max_depth: int = 6
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    subsample: float = 0.8
    colsample: float = 0.8
    bins: int = 32
    seed: int = 42


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Ascending cuts half-way between neighbouring distinct values."""
    u = np.unique(x)
    low = u[:-1]
    if len(u) > bins:
        q = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))
        low = q[q < u[-1]]
    return (low + u[np.searchsorted(u, low, "right")]) / 2 if len(low) else low


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cuts below it."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)


def _kept(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


@dataclass
class Tree:
    """Node arrays; node 0 is the root, the children of i are ``left[i]`` and the
    next one, and a leaf has ``left`` -1. Values above ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, b: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), int), np.arange(len(b))
        while True:
            down = self.left[at]
            if (down < 0).all():
                return self.value[at]
            at = np.where(down < 0, at, down + (b[rows, self.feature[at]] > self.cut[at]))


def grow(b: np.ndarray, g: np.ndarray, shape: Shape, features: np.ndarray) -> Tree:
    """One tree on binned rows ``b`` with gradients ``g``, all nodes of a level at once."""
    size = min(2 ** (shape.max_depth + 1), 2 * len(b)) + 1
    feature, cut, left = np.zeros(size, int), np.zeros(size, int), np.full(size, -1)
    sg, sh, gain = np.zeros(size), np.zeros(size), np.zeros(size)
    sg[0], sh[0], count = g.sum(), len(b), 1
    b, nf, nb = b[:, features], len(features), shape.bins

    def worth(s, h):
        return _kept(s, shape.alpha) ** 2 / np.maximum(h + shape.lam, 1e-300)

    ids, node, levels = np.zeros(1, int), np.zeros(len(b), int), []
    for _ in range(shape.max_depth):
        m = len(ids)
        flat = ((node[:, None] * nf + np.arange(nf)) * nb + b).ravel()
        lg = np.bincount(flat, np.repeat(g, nf), m * nf * nb).reshape(m, nf, nb).cumsum(2)[:, :, :-1].reshape(m, -1)
        lh = np.bincount(flat, minlength=m * nf * nb).reshape(m, nf, nb).cumsum(2)[:, :, :-1].reshape(m, -1)
        rg, rh = sg[ids][:, None] - lg, sh[ids][:, None] - lh
        total = np.where((lh > 0) & (rh > 0), worth(lg, lh) + worth(rg, rh), -np.inf)
        best = total.argmax(1) if total.shape[1] else np.zeros(m, int)
        won = total[np.arange(m), best] - worth(sg[ids], sh[ids]) if total.shape[1] else np.full(m, -np.inf)
        ok = won > MIN_GAIN
        if not ok.any():
            break
        split, kids = ids[ok], count + 2 * np.arange(ok.sum())
        f, cut[split] = np.divmod(best[ok], nb - 1)
        feature[split], gain[split], left[split] = features[f], won[ok], kids
        sg[kids], sh[kids] = lg[ok, best[ok]], lh[ok, best[ok]]
        sg[kids + 1], sh[kids + 1] = sg[split] - sg[kids], sh[split] - sh[kids]
        levels.append(split)
        to = np.full(m, -1)
        to[ok] = np.arange(len(split))
        to = to[node]
        go = to >= 0
        b, g, to = b[go], g[go], to[go]
        node = 2 * to + (b[np.arange(len(b)), f[to]] > cut[split[to]])
        ids = np.arange(count, count + 2 * len(split))
        count += 2 * len(split)
    for split in reversed(levels):
        left[split[(left[left[split]] < 0) & (left[left[split] + 1] < 0) & (gain[split] < shape.gamma)]] = -1
    value = -_kept(sg, shape.alpha) / np.maximum(sh + shape.lam, 1e-300)
    return Tree(feature[:count], cut[:count], left[:count], shape.learning_rate * value[:count])


def staged(train: np.ndarray, y: np.ndarray, test: np.ndarray, shape: Shape, counts: list[int]) -> dict[int, np.ndarray]:
    """Predictions of ``test`` by ensembles of ``counts`` trees, all from one fit.
    The train rows are not empty and hold no missing value."""
    cuts = [cut_points(train[:, j], shape.bins) for j in range(train.shape[1])]
    both = binned(np.concatenate([train, test]), cuts)
    n, nf, rng = len(y), train.shape[1], np.random.default_rng(shape.seed)
    at = np.full(len(both), y.mean())
    out = {0: at[n:].copy()} if 0 in counts else {}
    for k in range(1, max(counts) + 1):
        rows = np.flatnonzero(rng.random(n) < shape.subsample) if shape.subsample < 1 else np.arange(n)
        features = np.sort(rng.permutation(nf)[:max(int(shape.colsample * nf), 1)]) if shape.colsample < 1 else np.arange(nf)
        if len(rows):
            at = at + grow(both[rows], at[rows] - y[rows], shape, features).predict(both)
        if k in counts:
            out[k] = at[n:].copy()
    return out
