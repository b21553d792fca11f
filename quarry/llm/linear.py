"""Hashed linear scorers over windows of words: features, fitting, scoring.

A window is a run of at most ``WINDOW`` words; its features are hashed into
``2**BITS`` slots and its score is the bias plus the sum of their weights over
the square root of their number. A text's score is that of its highest window,
so one window decides however long the text is.
"""

from __future__ import annotations

import numpy as np

BITS = 18
WINDOW = 64
CHUNK = 2048             # windows counted at once


def windows(per_doc: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(words of each window, windows of each text); a text without words has one empty window."""
    n = np.maximum(-(-per_doc // width), 1)
    doc = np.repeat(np.arange(len(per_doc)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(per_doc[doc] - k * width, width).clip(min=0), n


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def segment_max(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Maximum of each segment; all have one value at least."""
    return np.maximum.reduceat(values, np.cumsum(lengths) - lengths) if len(values) else values


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def margins(weights: np.ndarray, bias: float, slots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Score of each window; ``slots`` (words, features) are its words' slots."""
    total = segment_sum(weights[slots].sum(axis=1, dtype=np.float64), lengths)
    return bias + total / np.sqrt(np.maximum(lengths * slots.shape[1], 1))


def association(present: np.ndarray, positive: np.ndarray, share: float, prior: float = 10.0) -> np.ndarray:
    """Shrunken log odds of each slot: how much more (or less) often the
    windows that hold it are positive than all windows, 0 within a factor e."""
    odds = np.log((positive + prior * share) / (present - positive + prior * (1 - share)) * (1 - share) / share)
    return np.sign(odds) * np.maximum(np.abs(odds) - 1.0, 0.0)


def fit(slots: np.ndarray, lengths: np.ndarray, target: np.ndarray, dense: np.ndarray | None = None,
        rounds: int = 80, rate: float = 0.3, l2: float = 0.03):
    """Logistic regression of ``target`` (a probability per window) by full
    gradients with Adam's step sizes. Each slot enters with its association
    with the target as its scale, so slots met by chance stay out. Returns
    (weights, bias, weights of the dense features)."""
    n, size = len(lengths), 1 << BITS
    extra = dense if dense is not None else np.zeros((n, 0))
    weights = np.zeros(size, np.float32)
    if not n:
        return weights, 0.0, np.zeros(extra.shape[1])
    share = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    present, positive = np.zeros(size), np.zeros(size)
    ends = np.cumsum(lengths)
    for at in range(0, n, CHUNK):                 # slots of each window once, some windows at a time
        part = lengths[at:at + CHUNK]
        own = slots[ends[at] - lengths[at]:ends[at + len(part) - 1]].ravel()
        pair = np.unique(np.repeat(np.arange(len(part)), part * slots.shape[1]) * size + own)
        present += np.bincount(pair % size, minlength=size)
        positive += np.bincount(pair % size, target[at + pair // size], size)
    scale = association(present, positive, share)
    alive = np.flatnonzero(scale)
    new = np.full(size, -1, np.int32)
    new[alive] = np.arange(k := len(alive))
    used = np.flatnonzero(new[slots.ravel()] >= 0)
    flat = new[slots.ravel()[used]]
    rows = np.searchsorted(ends * slots.shape[1], used, side="right")
    del used
    value = scale[alive][flat] / np.sqrt(np.maximum(lengths * slots.shape[1], 1))[rows]
    theta = np.zeros(k + extra.shape[1] + 1)
    theta[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, theta[flat] * value, n) + extra @ theta[k:-1] + theta[-1]
        error = (sigmoid(z) - target) / n
        g = np.concatenate([np.bincount(flat, error[rows] * value, k), error @ extra, [error.sum()]])
        g[:-1] += l2 * theta[:-1] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9) / (1 + 3 * t / rounds)
    weights[alive] = theta[:k] * scale[alive]
    return weights, float(theta[-1]), theta[k:-1].copy()
