"""Follow-the-regularised-leader (proximal) for sparse softmax regression with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal; weights of a coordinate stay at zero until evidence exceeds ``l1``."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, target: int) -> None:
        """One example: distinct coordinates, their values, and the class."""
        w = self.weights(at)
        p = softmax(value @ w)
        p[target] -= 1.0
        g = value[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the logits that gives held-back examples the greatest likelihood."""
    if not len(target):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
