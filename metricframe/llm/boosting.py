"""Gradient-boosted decision trees for a few classes, in numpy.

Features are cut into at most :data:`BINS` bins; a tree is grown level by level to a
fixed depth on histograms of gradients and hessians of the softmax loss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Boosted:
    """Trees as (rounds, classes, nodes) arrays; node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    edges: list[np.ndarray]
    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray
    depth: int
    base: np.ndarray

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        rows = np.arange(len(x))
        scores = np.tile(self.base, (len(x), 1))
        for feature, above, value in zip(self.feature, self.above, self.value, strict=True):
            for c in range(scores.shape[1]):
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (binned[rows, feature[c][at]] > above[c][at])
                scores[:, c] += value[c][at]
        return np.log(softmax(scores) + 1e-9)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit(
    x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 24, depth: int = 4, rate: float = 0.3, penalty: float = 1.0, least: int = 5
) -> Boosted:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = _binned(x, edges)
    base = np.log(np.bincount(y, minlength=classes) / len(y) + 1e-6)
    scores = np.tile(base, (len(y), 1))
    size = 2 ** (depth + 1) - 1
    features, aboves, values = [], [], []
    for _ in range(rounds):
        p = softmax(scores)
        feature = np.zeros((classes, size), np.int64)
        above = np.full((classes, size), BINS, np.int64)
        value = np.zeros((classes, size))
        for c in range(classes):
            gradient, hessian = p[:, c] - (y == c), p[:, c] * (1 - p[:, c]) + 1e-6
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, wide = 2**level - 1, 2**level
                slot = (at - first) * BINS
                best_gain = np.full(wide, 1e-9)
                total_g = np.bincount(at - first, gradient, wide)
                total_h = np.bincount(at - first, hessian, wide)
                for j in range(x.shape[1]):
                    where = slot + binned[:, j]
                    g = np.bincount(where, gradient, wide * BINS).reshape(wide, BINS).cumsum(1)[:, :-1]
                    h = np.bincount(where, hessian, wide * BINS).reshape(wide, BINS).cumsum(1)[:, :-1]
                    n = np.bincount(where, minlength=wide * BINS).reshape(wide, BINS).cumsum(1)
                    other_g, other_h = total_g[:, None] - g, total_h[:, None] - h
                    gain = g**2 / (h + penalty) + other_g**2 / (other_h + penalty) - (total_g**2 / (total_h + penalty))[:, None]
                    gain[(n[:, :-1] < least) | (n[:, -1:] - n[:, :-1] < least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(wide), top] > best_gain
                    best_gain[better] = gain[np.arange(wide), top][better]
                    feature[c, first : first + wide][better] = j
                    above[c, first : first + wide][better] = top[better]
                at = 2 * at + 1 + (binned[np.arange(len(y)), feature[c][at]] > above[c][at])
            g, h = np.bincount(at, gradient, size), np.bincount(at, hessian, size)
            value[c] = -rate * g / (h + penalty)
            scores[:, c] += value[c][at]
        features.append(feature)
        aboves.append(above)
        values.append(value)
    return Boosted(edges, np.stack(features), np.stack(aboves), np.stack(values), depth, base)
