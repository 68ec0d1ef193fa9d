"""Sparse multinomial logistic regression by follow-the-regularised-leader, and temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, size: int, kinds: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 3,
) -> np.ndarray:
    """Weights, size x kinds, after passes over sparse rows (feature numbers, values) in random order.

    Each coordinate has its own learning rate; the elastic-net penalties are applied to the running sums,
    so weights below the L1 mark are exactly zero.
    """
    z, n = np.zeros((size, kinds)), np.zeros((size, kinds))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax(value @ w)
            error[classes[k]] -= 1
            g = value[:, None] * error
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not fitted."""
    if not len(logits):
        return 1.0
    low, high = np.log(0.02), np.log(50.0)

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(classes)), classes]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    for _ in range(60):  # ternary search: the loss is unimodal in the temperature
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
