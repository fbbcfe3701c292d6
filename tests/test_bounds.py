"""Bounds kept beside the rows: the labels and centroids of plain rounds, with fewer distances."""

import numpy as np
import pytest

from vecloom import EmbeddingCluster, KMeans
from vecloom.operators import bounds as B
from vecloom.operators.assign import nearest_one, normalized, pairwise
from vecloom.sources.tables import from_numpy


def drifting(c, rng, step):
    return c + rng.normal(0, step, c.shape)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "dot"])
@pytest.mark.parametrize("step", [0.0, 0.001, 0.05, 2.0])
def test_labels_are_those_of_all_distances(metric, step):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5)) + 4 * rng.normal(size=(12, 5))[rng.integers(12, size=3000)]
    c = x[rng.choice(3000, 20, replace=False)].copy()
    x[:4] = 0  # zero rows
    x[4] = c[7]  # a row at a centroid
    x[5] = (c[1] + c[2]) / 2  # one between two
    if metric == "dot":
        x, c = normalized(x), normalized(c)
    held = B.anchored(x, c, metric)
    want = pairwise(x, c, metric)
    assert (held[0] == nearest_one(x, c, metric)[0]).all()
    now = drifting(c, rng, step)
    if metric == "dot":
        now = normalized(now)
    label, best, measured = B.labelled(x, now, metric, held, B.moves(now, c, metric))
    plain, near = nearest_one(x, now, metric)
    assert (label == plain).all() and np.allclose(best, near, atol=1e-12)
    assert measured <= len(x) * (1 + len(c)) and want.shape == (3000, 20)
    if step <= 0.001:
        assert measured < 0.3 * len(x) * len(c)


def test_hostile_numbers():
    """Copies of centroids, zero centroids, one centroid, groups far apart, numbers that are not finite."""
    rng = np.random.default_rng(5)
    far = np.vstack([rng.normal(s * 1e7, 0.05, (40, 4)) for s in (-1, 1)])
    for metric in ("euclidean", "manhattan", "cosine"):
        for c in (np.vstack([far[:10], far[40:50]]), np.vstack([far[:3], far[:3]]), np.vstack([np.zeros((2, 4)), far[:2]]), far[:1]):
            for now in (c, c + rng.normal(0, 0.01, c.shape), c[::-1].copy()):
                label, best, _ = B.labelled(far, now, metric, B.anchored(far, c, metric), B.moves(now, c, metric))
                plain, near = nearest_one(far, now, metric)
                assert (label == plain).all() and np.allclose(best, near, atol=1e-9)
    x = far.copy()
    x[3, 1], x[4, 0] = np.nan, np.inf
    held = B.anchored(x, far[:5], "euclidean")
    assert held[1][3] == held[1][4] == -np.inf
    label = B.labelled(x, far[:5], "euclidean", held, B.moves(far[:5], far[:5], "euclidean"))[0]
    assert (label == nearest_one(x, far[:5], "euclidean")[0]).all()
    assert B.labelled(x[:0], far[:5], "euclidean", (held[0][:0], held[1][:0]), B.moves(far[:5], far[:5], "euclidean"))[2] == 0


def test_anchors_survive_packing():
    held = [(np.array([1, 2], np.int32), np.array([0.5, -np.inf], np.float32)), None, (np.array([0, 3], np.int32), np.array([2, 3], np.float32))]
    back = B.unpacked(B.packed(held), 2, [True, False, True])
    assert back[1] is None and all((a == b).all() for r in (0, 2) for a, b in zip(held[r], back[r]))


@pytest.mark.parametrize("local_bytes", [1 << 24, 0])
def test_same_fit_with_few_distances(spark, local_bytes):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 6)) + 6 * rng.normal(size=(30, 6))[rng.integers(30, size=20000)]
    df = from_numpy(spark, x)
    fit = {"max_iter": 25, "n_init": 2, "tol": 1e-9, "local_bytes": local_bytes}
    plain, quick = KMeans(30, algorithm="lloyd", **fit), KMeans(30, algorithm="hamerly", **fit)
    a, b = plain.fit(df), quick.fit(df)
    assert np.allclose(a.cluster_centers_, b.cluster_centers_, rtol=1e-12, atol=1e-12) and a.n_iter_ == b.n_iter_ and a.inertia_ == pytest.approx(b.inertia_, rel=1e-12)
    assert set(plain.distance_shares_) == {1.0}
    late = [s for s in quick.distance_shares_[5:] if s < 1]
    print("shares", local_bytes, np.round(quick.distance_shares_, 3).tolist())
    assert np.mean(quick.distance_shares_[5:]) < 0.3 and max(late) < 0.3


def test_same_fit_on_the_sphere(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 8)) + 3 * rng.normal(size=(15, 8))[rng.integers(15, size=6000)]
    x[7] = 0
    df = from_numpy(spark, x)
    fit = {"reduction_dim": None, "max_iter": 20, "n_init": 2, "local_bytes": 0}
    plain, quick = EmbeddingCluster(15, **fit).fit(df), EmbeddingCluster(15, algorithm="hamerly", **fit).fit(df)
    assert np.allclose(plain.model.cluster_centers_, quick.model.cluster_centers_, atol=1e-12) and plain.model.n_iter_ == quick.model.n_iter_
    columns = ("run", "iteration", "churn")
    assert plain.telemetry_.select(*columns).orderBy(*columns).collect() == quick.telemetry_.select(*columns).orderBy(*columns).collect()
    print("shares", np.round(quick.distance_shares_, 3).tolist(), "plain", np.round(plain.distance_shares_, 3).tolist())
    assert sum(quick.distance_shares_) < sum(plain.distance_shares_)
