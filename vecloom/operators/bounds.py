"""Bounds that outlive a Lloyd round, so that rows whose centroid cannot have changed meet no other.

At an *anchor* each row's centroid and a lower bound of its distance to all others are written beside its
block, once.  Later rounds leave that table as it is: how far each centroid has moved since the anchor is a
few numbers of the model, travels with the centroids, and is taken off the stored bound.  A row keeps its
centroid if its distance to that, measured anew, is still below the bound, or below what the nearest other
centroid leaves room for.  Only rows in doubt are compared with every centroid, by the same rule as always,
so labels are those of plain rounds.  Nothing is joined and no state is rewritten from round to round;
when many rows are in doubt the driver asks for a new anchor, in rounds that double.

Triangle inequalities want metrics: Euclidean distance itself, Manhattan, and for cosine and dot products the
chord between unit vectors.  Zero vectors, and for dot products any that are not of unit length, are always
in doubt, as are numbers that are not finite.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vecloom.operators.assign import nearest_one, nearest_two, pairwise

SLACK = 1e-9  # relative room for rounding, far above what sums of some thousand terms lose
UNIT = 1e-12  # how far a squared length may be from 1


@dataclass
class Moves:
    """What a row needs to know of centroids that were ``anchors`` once: by centroid, the longest way any *other*
    has gone since, and the distance to the nearest other one now."""

    others: np.ndarray
    apart: np.ndarray


def _length(raw: np.ndarray, metric: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the metric distance behind computed raw ones."""
    if metric in ("cosine", "dot"):
        # the raw value may be off by this much, whatever its size
        off = UNIT + 4e-16 * (d + 4)
        square = 2 * (raw if metric == "cosine" else 1 + raw)
        low, high = np.sqrt(np.maximum(square - 2 * off, 0)), np.sqrt(np.maximum(square, 0) + 2 * off)
    else:
        low = high = np.sqrt(raw) if metric == "euclidean" else raw
    return low * (1 - SLACK), high * (1 + SLACK)


def _usable(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors for which the metric is one."""
    if metric not in ("cosine", "dot"):
        return np.isfinite(x).all(axis=1)
    length2 = np.einsum("ij,ij->i", x, x)
    return np.abs(length2 - 1) <= UNIT if metric == "dot" else (length2 > 1e-30) & (length2 < 1e300)


def own_distance(x: np.ndarray, c: np.ndarray, label: np.ndarray, metric: str) -> np.ndarray:
    """The raw distance of each row to its own centroid."""
    own = c[label]
    if metric in ("euclidean", "manhattan"):
        gap = x - own
        return np.einsum("ij,ij->i", gap, gap) if metric == "euclidean" else np.abs(gap).sum(1)
    dot = np.einsum("ij,ij->i", x, own)
    if metric == "dot":
        return -dot
    scale = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", own, own)
    return np.where(scale <= 0, 1.0, 1 - dot / np.sqrt(np.maximum(scale, 1e-300)))


def moves(c: np.ndarray, anchors: np.ndarray, metric: str) -> Moves:
    """How far the centroids ``c`` are from where the rows were anchored, and from each other."""
    k, d = c.shape
    with np.errstate(all="ignore"):
        way = _length(own_distance(anchors, c, np.arange(k), metric), metric, d)[1]
        way = np.where(_usable(c, metric) & _usable(anchors, metric) & np.isfinite(way), way, np.inf)
        order = np.argsort(way)
        others = np.full(k, way[order[-1]])
        others[order[-1]] = way[order[-2]] if k > 1 else 0.0
        apart = np.full(k, np.inf)
        if k > 1:
            near = np.empty(k)
            step = max(1, (1 << 22) // max(1, k))
            for s in range(0, k, step):
                far = pairwise(c[s : s + step], c, metric)
                far[np.arange(len(far)), np.arange(s, s + len(far))] = np.inf
                near[s : s + step] = far.min(axis=1)
            apart = np.where(_usable(c, metric).all(), _length(near, metric, d)[0], 0.0)
    return Moves(others, np.nan_to_num(apart, nan=0.0))


def anchored(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(label, lower bound of the distance to any other centroid) of each row; -inf where there is none."""
    label, _, second = nearest_two(x, c, metric)
    with np.errstate(all="ignore"):
        low = _length(second, metric, x.shape[1])[0]
        low = np.where(_usable(x, metric) & np.isfinite(low), np.clip(low, 0, 3e38), -np.inf)
        return label.astype(np.int32), np.nextafter(low.astype(np.float32), np.float32(-np.inf))


def labelled(x: np.ndarray, c: np.ndarray, metric: str, held: tuple[np.ndarray, np.ndarray] | None = None, since: Moves | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(label, raw distance, distances measured): what ``nearest_one`` gives, with fewer of them where rows are anchored."""
    if held is None or since is None or not len(x):
        return *nearest_one(x, c, metric), len(x) * len(c)
    label, low = held[0].astype(np.int64), held[1].astype(np.float64)
    with np.errstate(all="ignore"):
        best = own_distance(x, c, label, metric)
        reach = _length(best, metric, x.shape[1])[1]
        # the other centroids are at least this far: as anchored less their way, or by their distance from the own one
        room = np.maximum((low - since.others[label]) - SLACK * (np.abs(low) + since.others[label]), since.apart[label] - reach)
        doubt = np.nonzero(~((reach < room) & (low >= 0)))[0]
    if len(doubt):
        label[doubt], best[doubt] = nearest_one(x[doubt], c, metric)
    return label, best, len(x) + len(doubt) * len(c)


def packed(held: list[tuple[np.ndarray, np.ndarray] | None]) -> bytes:
    """The anchors of a block, restart by restart; those without are left out."""
    return b"".join(part.tobytes() for own in held if own is not None for part in own)


def unpacked(data: bytes, rows: int, known: list[bool]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    out, at = [], 0
    for has in known:
        if has:
            out.append((np.frombuffer(data, np.int32, rows, at), np.frombuffer(data, np.float32, rows, at + 4 * rows)))
            at += 8 * rows
        else:
            out.append(None)
    return out
