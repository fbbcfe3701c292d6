import numpy as np
import pytest

from vecloom import AgglomerativeClustering
from vecloom.operators.agglomerative import merged
from vecloom.sources.tables import from_numpy


def same_tree(a, b):
    assert np.allclose(np.sort(a.distances_), np.sort(b.distances_), rtol=1e-9)
    assert len(a.children_) == len(b.children_)


def labels(model):
    return [r.label for r in model.labels_.orderBy("id").collect()]


@pytest.mark.parametrize("linkage,metric", [("complete", "euclidean"), ("average", "euclidean"), ("average", "cosine"), ("complete", "manhattan")])
def test_rounds_give_the_tree_of_the_matrix(spark, linkage, metric):
    x = np.random.default_rng(3).normal(size=(150, 4))
    df = from_numpy(spark, x).repartition(3)
    held = AgglomerativeClustering(7, linkage, metric).fit(df)
    far = AgglomerativeClustering(7, linkage, metric, max_rows=20, block_rows=40).fit(df)
    assert labels(held) == labels(far)
    same_tree(AgglomerativeClustering(1, linkage, metric).fit(df), AgglomerativeClustering(1, linkage, metric, max_rows=20, block_rows=40).fit(df))


def test_down_to_one_cluster_with_equal_rows_and_grids(spark):
    rows = np.vstack([np.zeros((9, 2)), np.array([[i, j] for i in range(5) for j in range(5)], float)])
    for linkage in ("complete", "average"):
        far = AgglomerativeClustering(1, linkage, max_rows=1, block_rows=16).fit(from_numpy(spark, rows))
        assert len(far.distances_) == len(rows) - 1 and far.distances_[:8] == [0.0] * 8
        assert max(far.distances_) <= np.sqrt(32) + 1e-9


def test_three_thousand_rows_with_a_small_matrix(spark):
    x = np.random.default_rng(5).normal(size=(3000, 3)) + 15 * np.random.default_rng(6).integers(0, 5, (3000, 1))
    far = AgglomerativeClustering(5, "average", max_rows=400).fit(from_numpy(spark, x))
    want, _, heights = merged(x, 5, "average", "euclidean")
    assert labels(far) == want.tolist()
    assert np.allclose(np.sort(far.distances_), np.sort(heights), rtol=1e-9)
