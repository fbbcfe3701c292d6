import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_density_metrics import labels
from tests.test_clustering import same_partition
from vecloom import AgglomerativeClustering
from vecloom.operators import ward
from vecloom.operators.ward import nearest_clusters, ward_rounds
from vecloom.plans.frames import feature_frame
from vecloom.sources.tables import from_numpy


@pytest.mark.parametrize("rows, block_rows", [(70, 4096), (70, 30)])
def test_rounds_give_the_tree_of_the_matrix(spark, rows, block_rows):
    x = np.random.default_rng(3).normal(size=(150, 3)) ** 3
    held = AgglomerativeClustering(5, "ward").fit(from_numpy(spark, x))
    far = AgglomerativeClustering(5, "ward", max_rows=rows, block_rows=block_rows).fit(from_numpy(spark, x))
    assert np.allclose(far.distances_, held.distances_) and far.children_ == [tuple(map(int, c)) for c in held.children_]
    assert labels(far.labels_).tolist() == labels(held.labels_).tolist()
    assert np.allclose(sorted(r[0] for r in far.heights(spark).collect()), held.distances_)


def test_a_third_of_the_rows_are_equal(spark):
    x = np.random.default_rng(4).normal(size=(120, 2))
    x[::3] = x[0]
    held = AgglomerativeClustering(4, "ward").fit(from_numpy(spark, x))
    far = AgglomerativeClustering(4, "ward", max_rows=40, block_rows=30).fit(from_numpy(spark, x))
    assert np.allclose(far.distances_, held.distances_) and same_partition(labels(far.labels_), labels(held.labels_))
    same = AgglomerativeClustering(2, "ward", max_rows=10).fit(from_numpy(spark, np.ones((30, 2))))
    assert same.distances_ == [0.0] * 28 and len(set(labels(same.labels_))) == 2


def test_equal_gaps_merge_in_few_rounds(spark, monkeypatch):
    grid = np.array([(i, j) for i in range(12) for j in range(12)], float)
    seen = []
    counted = ward.nearest_clusters
    monkeypatch.setattr(ward, "nearest_clusters", lambda c, n, b: seen.append(n) or counted(c, n, b))
    far = AgglomerativeClustering(1, "ward", max_rows=40, block_rows=40).fit(from_numpy(spark, grid))
    h = np.array(far.distances_)
    assert len(h) == 143 and h[0] == 1 and len(seen) < 10
    assert np.isclose((h * h).sum() / 2, ((grid - grid.mean(0)) ** 2).sum())


def test_nearest_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=(150, 3)), rng.integers(1, 40, 150)
    frame = feature_frame(from_numpy(spark, x)).join(spark.createDataFrame([(k, int(v)) for k, v in enumerate(n)], "id long, n long"), "id")
    got = {r.src: r.dst for r in nearest_clusters(frame, 150, 20).collect()}
    w = ((x[:, None] - x[None]) ** 2).sum(2) * 2 * n[:, None] * n[None] / (n[:, None] + n[None])
    np.fill_diagonal(w, np.inf)
    assert [got[k] for k in range(150)] == w.argmin(1).tolist()


def test_sizes_add_up(spark):
    x = np.random.default_rng(6).normal(size=(60, 2))
    tree, left = ward_rounds(feature_frame(from_numpy(spark, x)), 30, 20)
    rest = left.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("id").alias("id")).first()
    assert rest["k"] <= 30 and rest["n"] == 60 and rest["id"] == 0 and tree.count() == 60 - rest["k"]
