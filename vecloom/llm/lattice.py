"""Decoding to the E8 lattice and its neighbouring cells, vectorised."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with even sum): round, and where the sum is odd round the
    coordinate with the largest error the other way."""
    rounded = np.rint(y)
    error = y - rounded
    odd = np.mod(rounded.sum(axis=1), 2) != 0
    worst = np.abs(error).argmax(axis=1)
    rows = np.nonzero(odd)[0]
    flip = np.where(error[rows, worst[rows]] >= 0, 1.0, -1.0)
    rounded[rows, worst[rows]] += flip
    return rounded


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + (1/2, ..., 1/2)."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest non-zero points of E8: the steps to the neighbouring cells."""
    pairs = []
    for a, b in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[a], v[b] = s, t
            pairs.append(v)
    halves = [np.array(s) * 0.5 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


ROOTS = minimal_vectors()


def cells(y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 1 + probes, 8): twice the nearest lattice point, then the ``probes`` next nearest of its
    neighbours (twice, so that coordinates are integers), and how much farther each is, squared."""
    base = nearest_e8(y)
    toward = (y - base) @ ROOTS.T  # the neighbour base + r is nearer the larger (y - base) . r
    best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
    points = np.concatenate([base[:, None, :], base[:, None, :] + ROOTS[best]], axis=1)
    farther = np.concatenate([np.zeros((len(y), 1)), 2 - 2 * np.take_along_axis(toward, best, axis=1)], axis=1)
    return np.rint(2 * points).astype(np.int64), farther


def product_cells(y: np.ndarray, probes: int) -> np.ndarray:
    """The own cell and the ``probes`` next nearest of the product of E8 lattices over blocks of eight
    dimensions: (rows, 1 + probes, dimensions)."""
    points, farther = cells(y[:, :8], probes)
    for k in range(8, y.shape[1], 8):
        more, extra = cells(y[:, k : k + 8], probes)
        total = (farther[:, :, None] + extra[:, None, :]).reshape(len(y), -1)
        order = np.argsort(total, axis=1, kind="stable")[:, : probes + 1]
        i, j = order // more.shape[1], order % more.shape[1]
        points = np.concatenate([np.take_along_axis(points, i[:, :, None], axis=1), np.take_along_axis(more, j[:, :, None], axis=1)], axis=2)
        farther = np.take_along_axis(total, order, axis=1)
    return points
