"""One-versus-rest linear classifiers on hashed features, trained on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def scale(starts: np.ndarray) -> np.ndarray:
    """For each feature one over the root of the number of its row's features."""
    n = np.diff(starts)
    return np.repeat(1 / np.sqrt(np.maximum(1, n)), n).astype(np.float32)


def scores(w: np.ndarray, bias: np.ndarray, ids: np.ndarray, starts: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
    """(rows, classes): the weighted sum of each row's features; row k has ids[starts[k]:starts[k + 1]]."""
    n = np.diff(starts)
    out = np.zeros((len(n), w.shape[1]), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        x = w[ids] if value is None else w[ids] * value[:, None]
        out[some] = np.add.reduceat(x, starts[:-1][some], axis=0)
    return (out / np.sqrt(np.maximum(1, n))[:, None].astype(np.float32) if value is None else out) + bias


def train(ids: np.ndarray, starts: np.ndarray, y: np.ndarray, size: int, epochs: int = 4, rate: float = 0.5, l2: float = 1e-6, batch: int = 128, steps: int = 300, seed: int = 3, value: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss per class by Adagrad over shuffled batches; y: (rows, classes) of 0 and 1; weight: of each row.

    Few rows are gone through more often, until there are `steps` batches.
    """
    classes = y.shape[1]
    w, g2 = np.zeros((size, classes), np.float32), np.full((size, classes), 1e-2, np.float32)
    bias, b2 = np.zeros(classes, np.float32), np.full(classes, 1e-2, np.float32)
    rng = np.random.default_rng(seed)
    lengths = np.diff(starts)
    value = scale(starts) if value is None else value
    rows = np.flatnonzero(lengths)
    for _ in range(max(epochs, -(-steps * batch // max(1, len(rows))))):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            r = rows[at : at + batch]
            n = lengths[r]
            first = np.r_[0, np.cumsum(n)[:-1]]
            flat = np.repeat(starts[r] - first, n) + np.arange(n.sum())
            f, v = ids[flat], value[flat]
            z = np.add.reduceat(w[f] * v[:, None], first, axis=0) + bias
            d = (1 / (1 + np.exp(-z)) - y[r]).astype(np.float32)
            if weight is not None:
                d *= weight[r][:, None]
            u, inv = np.unique(f, return_inverse=True)
            per = np.repeat(d, n, axis=0) * v[:, None]
            g = np.stack([np.bincount(inv, per[:, c], len(u)) for c in range(classes)], axis=1).astype(np.float32) / len(r) + l2 * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            gb = d.mean(axis=0)
            b2 += gb * gb
            bias -= rate * gb / np.sqrt(b2)
    return w, bias


def best_threshold(value: np.ndarray, truth: np.ndarray, weight: float = 1.0, share: float = 0.5) -> float:
    """The threshold with the best F1 of value >= threshold against truth; weight: what a negative counts.

    It lies in the gap below the last value kept, at this share of the gap from its lower end.
    """
    order = np.argsort(-value, kind="stable")
    v, t = value[order], truth[order].astype(float)
    tp, fp = np.cumsum(t), np.cumsum((1 - t) * weight)
    f1 = 2 * tp / np.maximum(1e-9, tp + fp + t.sum())
    f1[:-1][v[:-1] == v[1:]] = -1
    k = int(np.argmax(f1)) if len(v) else 0
    return float(v[k + 1] + (v[k] - v[k + 1]) * share if k + 1 < len(v) else v[k] - 1e-6) if len(v) else 0.0
