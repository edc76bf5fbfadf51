"""Small in-memory trainers for sparse rows, used on bounded samples.

Rows are (features, values) pairs of numpy arrays over at most 2**bits hashed features.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated arrays and the offsets of the rows."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0)), offsets


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over consecutive slices; empty slices give 0. Works along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ftrl(features: list[np.ndarray], values: list[np.ndarray], targets: np.ndarray, dims: int, *, l1: float,
         l2: float = 1.0, rate: float = 0.3, epochs: int = 4, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic weights by FTRL-proximal in small batches; the L1 term leaves most weights exactly 0."""
    z, n = np.zeros(dims), np.zeros(dims)
    bias, bias_n = 0.0, 1e-6
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        rows = order.permutation(len(features))
        for at in range(0, len(rows), batch):
            pick = rows[at : at + batch]
            feature, cut = flat([features[i] for i in pick])
            feature = feature.astype(np.int64)
            value, _ = flat([values[i] for i in pick])
            here, back = np.unique(feature, return_inverse=True)
            zz, nn = z[here], n[here]
            w = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1.0 + np.sqrt(nn)) / rate + l2))
            error = sigmoid(row_sums(value * w[back], cut) + bias) - targets[pick]
            g = np.bincount(back, value * np.repeat(error, np.diff(cut)), minlength=len(here))
            z[here] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / rate * w
            n[here] += g * g
            gb = float(error.sum())
            bias_n += gb * gb
            bias -= rate * gb / np.sqrt(bias_n)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / rate + l2))
    return w, bias
