"""Trees to conjunctive rules to lasso weights, in numpy on a bounded sample."""

from __future__ import annotations

import numpy as np

#: (feature index, True for "at most", threshold)
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _grow(binned, cuts, grad, hess, rows, path, depth, least, rules, step):
    """Splits ``rows`` where the squared gradient gains most; every node but the root is a rule."""
    best, total_g, total_h = (1e-6, None, None), grad[rows].sum(), hess[rows].sum()
    base = total_g * total_g / (total_h + 1.0)
    if depth:
        for f in range(binned.shape[1]):
            n_bins = len(cuts[f]) + 1
            if n_bins < 2:
                continue
            bins = binned[rows, f]
            g = np.bincount(bins, grad[rows], n_bins).cumsum()[:-1]
            h = np.bincount(bins, hess[rows], n_bins).cumsum()[:-1]
            n = np.bincount(bins, hess[rows] > 0, n_bins).cumsum()
            gain = g * g / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
            gain[(n[:-1] < least) | (n[-1] - n[:-1] < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
    _, f, at = best
    if f is None:
        step[rows] = -total_g / (total_h + 1.0)
        return
    left = binned[rows, f] <= at
    for at_most, part in ((True, rows[left]), (False, rows[~left])):
        longer = (*path, (f, at_most, float(cuts[f][at])))
        rules.add(_shortened(longer))
        _grow(binned, cuts, grad, hess, part, longer, depth - 1, least, rules, step)


def _shortened(path: Rule) -> Rule:
    """One bound per feature and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, at_most, cut in path:
        old = bounds.get((f, at_most), cut)
        bounds[f, at_most] = min(old, cut) if at_most else max(old, cut)
    return tuple(sorted((f, at_most, cut) for (f, at_most), cut in bounds.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Rules of boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    cuts = [c[c < column.max()] for c, column in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1)
    margin, rules, least = np.zeros(len(y)), set(), max(3, len(y) // 500)
    for _ in range(trees):
        p = _sigmoid(margin)
        chosen = rng.random(len(y)) < 0.5  # other rows weigh nothing, but get the leaf's step
        step = np.zeros(len(y))
        grad, hess = (p - y) * chosen, (p * (1 - p) + 1e-9) * chosen
        _grow(binned, cuts, grad, hess, np.arange(len(y)), (), depth, least, rules, step)
        margin += rate * step
    return sorted(rules)


def activations(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for f, at_most, cut in rule:
            out[:, k] *= (x[:, f] <= cut) if at_most else (x[:, f] > cut)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is free."""
    n, k = a.shape
    v = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(20):  # the largest eigenvalue sets the step
        u = a.T @ (a @ v) / n + 1.0 * v
        v = u / max(np.linalg.norm(u), 1e-12)
    lipschitz = 0.25 * (float(np.linalg.norm(a.T @ (a @ v) / n)) + 1.0) * 1.05
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = _sigmoid(a @ zw + zb) - y
        moved = zw - (a.T @ error / n) / lipschitz
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - penalty / lipschitz, 0)
        new_b = zb - error.mean() / lipschitz
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005, **tree_options) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights other than zero).  One class only: its smoothed rate."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) < 10 or y.min() == y.max():
        return float(np.log(rate / (1 - rate))), []
    rules = tree_rules(x, y, **tree_options)
    if not rules:
        return float(np.log(rate / (1 - rate))), []
    b, w = lasso_logistic(activations(x, rules), y, penalty)
    return b, [(rule, float(c)) for rule, c in zip(rules, w) if abs(c) > 1e-9]
