"""Nearest centroids: a matrix-product short list, then exact distances for what is on it.

The centroid table (k x d) is a model and travels by broadcast; rows are scored in a narrow Arrow map,
so there is no shuffle and the same plan serves batch and streaming input.  Ties go to the lowest
centroid number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecloom.functions.vectors import parse_metric
from vecloom.plans.frames import map_matrix

CHUNK = 1 << 22  # numbers held by one block of intermediate distances


def normalized(x: np.ndarray) -> np.ndarray:
    """Unit rows; rows whose squared norm is at most 1e-30 stay as they are."""
    length2 = np.einsum("ij,ij->i", x, x)
    return x * np.where(length2 > 1e-30, 1 / np.sqrt(np.maximum(length2, 1e-300)), 1.0)[:, None]


def pairwise(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Raw distances of all rows of x to all rows of c, exactly as defined (no expansion of squares).

    ``dot`` gives negated dot products, so that smaller is nearer everywhere.
    """
    if not len(x) or not len(c):
        return np.empty((len(x), len(c)))
    if metric == "dot":
        return -(x @ c.T)
    if metric == "cosine":
        scale = np.einsum("ij,ij->i", x, x)[:, None] * np.einsum("ij,ij->i", c, c)[None, :]
        return np.where(scale <= 0, 1.0, 1 - (x @ c.T) / np.sqrt(np.maximum(scale, 1e-300)))
    out = np.empty((len(x), len(c)))
    step = max(1, CHUNK // max(1, c.size))
    for s in range(0, len(x), step):
        gap = x[s : s + step, None, :] - c[None, :, :]
        out[s : s + step] = np.abs(gap).sum(2) if metric == "manhattan" else np.einsum("ijk,ijk->ij", gap, gap)
    return out


def _open(x: np.ndarray, c: np.ndarray, middle: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Least values of the expanded squares, and which centroids may be among the ``places`` nearest of each row.

    Both sides are taken from ``middle`` first.  The rounding of an expanded square grows with the distances
    of the row and of that centroid from it; a centroid is out only where its least value lies above the
    greatest value of ``places`` others.  A common term of each row is left out.
    """
    y, z = x - middle, c - middle
    y2, z2 = np.einsum("ij,ij->i", y, y), np.einsum("ij,ij->i", z, z)
    with np.errstate(invalid="ignore", over="ignore"):
        rough = z2[None, :] - 2 * (y @ z.T)
        error = np.sqrt(y2)[:, None] * (2 * np.sqrt(z2))[None, :]
        error += z2[None, :]
        error *= 4e-16 * (c.shape[1] + 4)
        rough += error
        limit = rough.min(axis=1) if places == 1 else np.partition(rough, places - 1, axis=1)[:, places - 1]
        error *= 2
        rough -= error
        return rough, rough <= limit[:, None]


def _short_list(x: np.ndarray, c: np.ndarray, keep: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(``keep`` centroid numbers a row in ascending order, whether they hold its ``places`` nearest for certain).

    A second look from the centroid that is nearest in the first settles rows whose centroids lie in groups
    far apart; what is still in doubt (many centroids within rounding of each other, or no numbers at all)
    is for the caller to compare with every centroid.
    """

    def look(part: np.ndarray, middle: np.ndarray):
        least, may = _open(part, c, middle, places)
        chosen = least.argmin(axis=1)[:, None] if keep == 1 else np.sort(np.argpartition(least, keep - 1, axis=1)[:, :keep], axis=1)
        counts = may.sum(axis=1)
        return chosen, (counts <= keep) & (counts >= places), least.argmin(axis=1)

    chosen, sure, near = look(x, c.mean(axis=0))
    doubt = np.nonzero(~sure)[0]
    for j in np.unique(near[doubt]):
        rows = doubt[near[doubt] == j]
        chosen[rows], sure[rows], _ = look(x[rows], c[j])
    return chosen, sure


def nearest_two(x: np.ndarray, c: np.ndarray, metric: str, variances: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, best, second) raw distances; second is +inf with a single centroid.

    With ``variances`` (k x d) distances are squared and scaled by the centroid's own variances.
    NaN distances are never nearest.  Euclidean rows are compared exactly with a short list that holds their
    two nearest whatever was rounded, or else with every centroid.
    """
    n, k = len(x), len(c)
    label, best, second = np.zeros(n, np.int64), np.empty(n), np.full(n, np.inf)
    keep = min(k, 6)
    step = max(1, CHUNK // max(1, max(k, keep * c.shape[1])))
    for s in range(0, n, step):
        part = x[s : s + step]
        if variances is not None:
            d = np.stack([((part - c[j]) ** 2 / variances[j]).sum(1) for j in range(k)], axis=1)
            found = _two_least(d)
        elif metric == "euclidean" and k > keep:
            chosen, sure = _short_list(part, c, keep, 2)
            gap = part[:, None, :] - c[chosen]
            at, *least = _two_least(np.einsum("ijk,ijk->ij", gap, gap))
            found = chosen[np.arange(len(part)), at], *least
            doubt = np.nonzero(~sure)[0]
            if len(doubt):
                for own, exact in zip(found, _two_least(pairwise(part[doubt], c, metric))):
                    own[doubt] = exact
        else:
            found = _two_least(pairwise(part, c, metric))
        label[s : s + step], best[s : s + step], second[s : s + step] = found
    return label, best, second


def _two_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the least, least, second least) of each row, the lower place on ties; d is changed."""
    d = np.where(np.isnan(d), np.inf, d)
    rows = np.arange(len(d))
    first = d.argmin(axis=1)
    best = d[rows, first]
    d[rows, first] = np.inf
    return first, best, d.min(axis=1)


def nearest_one(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(label, raw distance) of the nearest centroid, as ``nearest_two`` finds it, with a short list of one."""
    if metric != "euclidean" or len(c) == 1:
        label, best, _ = nearest_two(x, c, metric)
        return label, best
    middle = c.mean(axis=0)
    near = c - middle
    length2 = np.einsum("ij,ij->i", near, near)
    label, best = np.zeros(len(x), np.int64), np.empty(len(x))
    step = max(1, CHUNK // max(c.shape))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        moved = part - middle
        with np.errstate(invalid="ignore", over="ignore"):
            rough = length2[None, :] - 2 * (moved @ near.T)
            first = rough.argmin(axis=1)
            # one bound for all centroids is cheap; rows that it leaves in doubt get one of each centroid's own
            bound = 4e-16 * (c.shape[1] + 4) * (length2.max() + 2 * np.sqrt(np.einsum("ij,ij->i", moved, moved) * length2.max()))
            doubt = np.nonzero((rough <= (rough[np.arange(len(part)), first] + 2 * bound)[:, None]).sum(axis=1) != 1)[0]
        if len(doubt):
            chosen, sure = _short_list(part[doubt], c, 1, 1)
            first[doubt] = chosen[:, 0]
            doubt = doubt[~sure]
        if len(doubt):
            first[doubt] = _two_least(pairwise(part[doubt], c, metric))[0]
        gap = part - c[first]
        label[s : s + step], best[s : s + step] = first, np.einsum("ij,ij->i", gap, gap)
    return label, np.where(np.isnan(best), np.inf, best)


def confidence(best: np.ndarray, second: np.ndarray, similarity: bool = False) -> np.ndarray:
    """How clearly the best beats the second, within [0, 1]."""
    with np.errstate(all="ignore"):
        if similarity:
            value = np.where(np.isfinite(second) & (np.abs(best) >= 1e-30), 1 - np.clip(second / best, 0, 1), 0.0)
        else:
            value = np.where(np.isfinite(second) & (np.abs(second) >= 1e-30), 1 - np.clip(best / second, 0, 1), 0.0)
    return np.nan_to_num(value)


def scores(x: np.ndarray, c: np.ndarray, metric: str, variances: np.ndarray | None = None):
    """label, distance, second distance and confidence; with ``dot`` the distances are similarities."""
    label, best, second = nearest_two(x, c, metric, variances)
    if metric == "dot" and variances is None:
        return label, -best, -second, confidence(-best, -second, similarity=True)
    return label, best, second, confidence(best, second)


def assign(df: DataFrame, centroids: np.ndarray, metric: str = "euclidean", features: str = "features", name: str = "label") -> DataFrame:
    """``df`` with the number of the nearest centroid."""
    metric = metric if metric == "dot" else parse_metric(metric)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    return map_matrix(df, features, [(name, T.LongType(), pa.int64())], lambda x: [nearest_two(_checked(x, shared.value), shared.value, metric)[0]])


def assign_with_scores(df: DataFrame, centroids: np.ndarray, metric: str = "euclidean", features: str = "features", variances: np.ndarray | None = None) -> DataFrame:
    """``df`` with label, distance, second_distance and confidence."""
    metric = metric if metric == "dot" else parse_metric(metric)
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(centroids, dtype=np.float64), variances))
    added = [("label", T.LongType(), pa.int64()), *[(n, T.DoubleType(), pa.float64()) for n in ("distance", "second_distance", "confidence")]]
    return map_matrix(df, features, added, lambda x: list(scores(_checked(x, shared.value[0]), shared.value[0], metric, shared.value[1])))


def _checked(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if x.shape[1] != c.shape[1]:
        raise ValueError(f"vectors have {x.shape[1]} dimensions, the model {c.shape[1]}")
    return x
