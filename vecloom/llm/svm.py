"""Linear support vector machines and sigmoid calibration in NumPy, for bounded training samples."""

from __future__ import annotations

import numpy as np


def train_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 200, use: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised squared-hinge SVM; y is +-1, classes weigh the same.

    ``use`` marks the rows to learn from (all by default) without copying them.

    Accelerated gradient steps whose length follows from the largest singular value (power steps).
    """
    use = np.ones(len(y), dtype=bool) if use is None else use
    positive, negative = ((y > 0) & use).sum(), ((y <= 0) & use).sum()
    share = (np.where(y > 0, 0.5 / max(1, positive), 0.5 / max(1, negative)) * use).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    ahead, before, t = w.copy(), w.copy(), 1.0
    y = y.astype(np.float32)
    rate = 1.0 / (2.0 * _curvature(x, share) + reg)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * y * share
        gradient = np.append(-2 * (slack @ x) + reg * ahead[:-1], -2 * slack.sum()).astype(np.float32)
        w = ahead - rate * gradient
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = w + ((t - 1) / t_next) * (w - before)
        before, t = w, t_next
    return w[:-1], float(w[-1])


def _curvature(x: np.ndarray, share: np.ndarray, steps: int = 12) -> float:
    """An upper estimate of the largest eigenvalue of the share-weighted second moments of (x, 1)."""
    v = np.ones(x.shape[1] + 1, dtype=np.float32)
    value = 1.0
    for _ in range(steps):
        v /= max(float(np.linalg.norm(v)), 1e-30)
        z = (x @ v[:-1] + v[-1]) * share
        v = np.append(z @ x, z.sum()).astype(np.float32)
        value = float(np.linalg.norm(v))
    return 1.05 * value + 1e-6


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) with P(y = 1) = 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets (Platt)."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum(), d.sum()]) + 1e-3 * np.array([a - 1, b])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return max(a, 1e-3), b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int, use: np.ndarray | None = None, **options) -> np.ndarray:
    """The margin of every row from a machine that never saw the row's fold (nor rows not in use)."""
    margin = np.zeros(len(y), dtype=np.float64)
    for k in range(folds):
        test = fold == k
        if test.any():
            w, b = train_svm(x, y, use=~test if use is None else use & ~test, **options)
            margin[test] = x[test] @ w + b
    return margin
