"""Starts and batches are drawn from all rows, by one rule for held and distributed ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import EmbeddingCluster, KMeans, MiniBatchKMeans
from vecloom.operators import lloyd as L
from vecloom.operators.assign import nearest_one
from vecloom.plans.frames import feature_frame
from vecloom.sources.tables import from_numpy


def sides(spark, x, partitions=5):
    frame = feature_frame(from_numpy(spark, x))
    n, d = x.shape
    return L.rows_of(frame, n, d), L.rows_of(frame.repartition(partitions), n, d, 0)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "dot"])
def test_same_starts_held_and_distributed(spark, metric):
    x = np.random.default_rng(0).normal(size=(900, 4))
    if metric == "dot":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    held, far = sides(spark, x)
    assert isinstance(held, L.LocalRows) and isinstance(far, L.SparkRows)
    for a, b in zip(L.starts(held, 7, [3, 4], metric), L.starts(far, 7, [3, 4], metric)):
        assert (a == b).all()
    assert np.allclose(held.batch(100, 5), far.batch(100, 5))


def test_same_fits_on_either_side_of_the_size_that_is_held(spark):
    x = np.random.default_rng(1).normal(size=(5000, 4))
    df = from_numpy(spark, x)
    a, b = KMeans(12, max_iter=15, n_init=3).fit(df), KMeans(12, max_iter=15, n_init=3, local_bytes=0).fit(df)
    assert a.inertia_ == pytest.approx(b.inertia_, rel=1e-12) and np.allclose(a.cluster_centers_, b.cluster_centers_)
    a, b = (MiniBatchKMeans(5, batch_size=200, max_iter=12, local_bytes=s).fit(df) for s in (1 << 24, 0))
    assert a.inertia_ == pytest.approx(b.inertia_, rel=1e-12)
    a, b = (EmbeddingCluster(5, None, n_init=2, max_iter=10, local_bytes=s).fit(df) for s in (1 << 24, 0))
    assert a.objective_ == pytest.approx(b.objective_, rel=1e-12)


def test_draws_follow_the_weights():
    keys = np.arange(40_000, dtype=np.int64) * 7919
    x = np.zeros((40_000, 1))
    x[:400] = 30.0  # 1 % of the rows, far from what is known
    x[400:] = 1.0
    hits = [(L.first_in(keys, x, 50, seed, np.zeros((1, 1)), "euclidean")[2] == 30.0).mean() for seed in range(40)]
    share = 400 * 900 / (400 * 900 + 39_600)
    assert abs(np.mean(hits) - share) < 0.03
    even = [(L.first_in(keys, x, 200, seed, None, "euclidean")[2] == 30.0).mean() for seed in range(40)]
    assert abs(np.mean(even) - 0.01) < 0.006
    times = L.race(keys, 5)
    assert abs(times.mean() - 1) < 0.02 and len(np.unique(times)) == len(times)


def test_rare_far_groups_get_a_centre(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (30_000, 3)), *[rng.normal(0, 0.1, (4, 3)) + 200 * np.eye(3)[j] for j in range(3)]])
    for rows in sides(spark, x):
        missed = [nearest_one(200 * np.eye(3), begun, "euclidean")[1].max() for begun in L.starts(rows, 4, list(range(10)), "euclidean")]
        assert min(missed) < 25


def test_fewer_different_rows_than_clusters(spark):
    x = np.repeat(np.array([[0.0, 0], [1, 1]]), 20, axis=0)
    for local in (1 << 20, 0):
        model = KMeans(3, n_init=2, local_bytes=local).fit(from_numpy(spark, x))
        assert model.inertia_ == 0
    every = KMeans(6, n_init=1, local_bytes=0).fit(from_numpy(spark, np.arange(6.0)[:, None]))
    assert every.inertia_ == 0


def test_one_matrix_of_sums_reaches_the_driver(spark, monkeypatch):
    monkeypatch.setattr(L, "PARTIAL_BYTES", 0)
    x = np.random.default_rng(4).normal(size=(800, 3))
    held, far = sides(spark, x, 8)
    seen = []
    unpack = L._unpacked
    monkeypatch.setattr(L, "_unpacked", lambda batch, *a: (seen.append(batch.num_rows), unpack(batch, *a))[1])
    runs = [x[:4], None, x[4:9]]
    a, b = held.round(runs, "euclidean"), far.round(runs, "euclidean")
    assert sum(seen) == 2 and b[1] is None
    for r in (0, 2):
        assert np.allclose(a[r].total, b[r].total) and (a[r].n == b[r].n).all() and a[r].far == pytest.approx(b[r].far)


def test_ids_of_any_kind(spark):
    x = np.random.default_rng(6).normal(size=(200, 2))
    df = from_numpy(spark, x).withColumn("id", F.concat(F.lit("row-"), "id"))
    assert KMeans(3, n_init=1).fit(df).inertia_ == pytest.approx(KMeans(3, n_init=1, local_bytes=0).fit(df).inertia_)
