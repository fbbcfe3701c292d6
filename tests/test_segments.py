"""All children of a hierarchy in one fit: the children that fits one by one give, jobs that do not grow with them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import ClusterSnapshot, EmbeddingCluster, HierarchicalSnapshot, KMeans
from vecloom.operators.segments import fit_segments
from vecloom.sources.tables import from_numpy


def table(spark, n=3000, d=5, groups=9):
    rng = np.random.default_rng(8)
    # a third of all rows in one root cluster
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(groups, size=n))
    x = rng.normal(size=(n, d)) + 25 * rng.normal(size=(groups, d))[at]
    x[5], x[6] = x[7], 0
    return x, from_numpy(spark, x)


def jobs_of(spark, work):
    """How many jobs ``work`` starts."""
    group = f"count-{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(group, group)
    made = work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, found


def test_same_children_as_fits_one_by_one(spark):
    x, df = table(spark)
    model = KMeans(9, n_init=2, max_iter=10).fit(df)
    fit = {"random_state": 4, "n_init": 2, "max_iter": 12}
    tree = HierarchicalSnapshot.build(df, model, {0: 3, 1: 2, 2: 4}, **fit)
    routed = model.transform(df)
    assert tree.n_children == 9
    for j, child in tree.children.items():
        alone = EmbeddingCluster({0: 3, 1: 2, 2: 4}.get(j, 5), reduction_dim=None, **fit).fit(routed.where(F.col("label") == j).drop("label")).snapshot()
        assert child.k == alone.k and child.sizes == alone.sizes and child.spherical and child.algorithm == alone.algorithm
        assert np.allclose(child.centroids, alone.centroids, atol=1e-9) and np.allclose(child.fit_mean, alone.fit_mean, atol=1e-9)
    assert sum(sum(c.sizes) for c in tree.children.values()) == len(x)


def test_jobs_do_not_grow_with_the_segments(spark):
    x, df = table(spark, 1200, 3, 4)
    counts = []
    for parts in (2, 24):
        rows = df.withColumn("part", F.col("id") % parts)
        models = {s: EmbeddingCluster(2, None, n_init=1, max_iter=3, tol=0.0) for s in range(parts)}
        made, jobs = jobs_of(spark, lambda: fit_segments(rows, "part", models))
        assert sorted(made) == list(range(parts)) and sum(sum(s.sizes) for s in made.values()) == 1200
        counts.append(jobs)
    assert 0 < counts[1] <= counts[0] + 4, counts


def test_small_empty_and_absent_segments(spark):
    x, df = table(spark, 200, 3, 2)
    rows = df.withColumn("part", F.when(F.col("id") < 4, 0).when(F.col("id") < 100, 7))  # the rest has no part
    made = fit_segments(rows, "part", {0: EmbeddingCluster(4, None, n_init=1), 7: EmbeddingCluster(3, None, n_init=1)})
    assert sum(made[0].sizes) == 4 and sum(made[7].sizes) == 96
    assert fit_segments(rows, "part", {}) == {}
    same = from_numpy(spark, np.ones((30, 3))).withColumn("part", F.lit(1))
    assert sum(fit_segments(same, "part", {1: EmbeddingCluster(3, None, n_init=1)})[1].sizes) == 30
    with pytest.raises(ValueError):
        fit_segments(df.limit(0).withColumn("part", F.lit(1)), "part", {1: EmbeddingCluster(2, None)})


def test_one_table_by_root(spark, tmp_path):
    x, df = table(spark, 900, 4, 4)
    tree = HierarchicalSnapshot.build(df, KMeans(4, n_init=1, max_iter=5).fit(df), 2, n_init=1, max_iter=5)
    tree.children[1].calibrate(df)
    path = str(tmp_path / "tree")
    tree.save(spark, path)
    assert sorted(f for f in os.listdir(f"{path}/children") if f.startswith("root_id=")) == [f"root_id={j}" for j in sorted(tree.children)]
    back = HierarchicalSnapshot.load(spark, path)
    for j, child in tree.children.items():
        own = back.children[j]
        assert (own.centroids == child.centroids).all() and own.sizes == child.sizes and own.spherical and own.is_calibrated == child.is_calibrated
    assert (back.children[1].confidence_percentiles == tree.children[1].confidence_percentiles).all()
    assert list(HierarchicalSnapshot.load(spark, path, only=[2]).children) == [2]
    bare = HierarchicalSnapshot(tree.root, {})
    bare.save(spark, path)
    assert HierarchicalSnapshot.load(spark, path).n_children == 0


def test_the_earlier_layout_is_still_read(spark, tmp_path):
    from vecloom.operators.kmeans import save_vectors

    root, child = ClusterSnapshot([[0.0, 1.0], [5.0, 5.0]]), ClusterSnapshot([[1.0, 0.0], [0.0, 1.0]], spherical=True)
    root.save(spark, str(tmp_path / "root"))
    child.save(spark, str(tmp_path / "children" / "1"))
    save_vectors(spark, str(tmp_path / "hierarchy"), {"children": [1]})
    back = HierarchicalSnapshot.load(spark, str(tmp_path))
    assert list(back.children) == [1] and (back.children[1].centroids == child.centroids).all()
