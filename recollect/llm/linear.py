"""Small numpy trainers shared by the classifiers; all work on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def adam(params: list[np.ndarray], gradient, steps: int, rate: float) -> list[np.ndarray]:
    """Full-batch Adam; ``gradient`` maps the parameters to their gradients."""
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(params), m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return params


def class_weights(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same total, mean 1."""
    pos = max(1, int(y.sum()))
    neg = max(1, len(y) - pos)
    return np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of ``sigmoid(a * z + b)`` fitted with smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def gradient(p):
        d = sigmoid(p[0][0] * z + p[0][1]) - target
        return [np.array([(d * z).mean(), d.mean()])]

    a, b = adam([np.array([1.0, 0.0])], gradient, 400, 0.05)[0]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature T, of a grid, for which ``sigmoid(z / T)`` has the least log loss."""
    if not len(y):
        return 1.0
    sign = np.where(y > 0, 1.0, -1.0)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [np.logaddexp(0, -sign * z / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
