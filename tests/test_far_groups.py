"""Centroids in groups far apart, and far from the origin: what is labelled must not depend on rounding."""

import numpy as np
import pytest

from vecloom import ClusterSnapshot
from vecloom.operators.assign import assign, assign_with_scores, confidence, nearest_one, nearest_two, pairwise
from vecloom.operators.kmeans import CentroidModel
from vecloom.plans import durable
from vecloom.sources.tables import from_numpy


def groups(off, rows=400, k=50, d=8, seed=0):
    rng = np.random.default_rng(seed)
    c = np.vstack([off + rng.normal(0, 0.05, (k, d)), -off + rng.normal(0, 0.05, (k, d))])
    x = np.vstack([off + rng.normal(0, 0.05, (rows, d)), -off + rng.normal(0, 0.05, (rows, d))])
    return x, c


@pytest.mark.parametrize("off", [0, 1e3, 1e6, 1e7, 1e9])
def test_no_wrong_label_or_second_distance(off):
    x, c = groups(off)
    exact = pairwise(x, c, "euclidean")
    label, best, second = nearest_two(x, c, "euclidean")
    assert (label == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert (second == np.partition(exact, 1, axis=1)[:, 1]).all()
    one, at = nearest_one(x, c, "euclidean")
    assert (one == label).all() and (at == best).all()


def test_many_centroids_at_one_place_and_numbers_that_overflow():
    x, c = groups(1e7, 50)
    c = np.vstack([c, np.repeat(c[:1], 20, axis=0)])
    exact = pairwise(x, c, "euclidean")
    label, best, second = nearest_two(x, c, "euclidean")
    assert (label == exact.argmin(1)).all() and (second == np.partition(exact, 1, axis=1)[:, 1]).all()
    odd = np.array([[np.nan] * 8, [np.inf] * 8, [1e200] * 8])
    assert nearest_two(odd, c, "euclidean")[0].tolist() == nearest_one(odd, c, "euclidean")[0].tolist() == [0, 0, 0]


def test_fit_transform_and_snapshots_agree(spark):
    x, c = groups(1e7, 300)
    exact = pairwise(x, c, "euclidean")
    want, second = exact.argmin(1), np.partition(exact, 1, axis=1)[:, 1]
    df = from_numpy(spark, x)
    assert [r.label for r in assign(df, c).orderBy("id").collect()] == want.tolist()
    rows = assign_with_scores(df, c).orderBy("id").collect()
    assert [r.label for r in rows] == want.tolist() and [r.second_distance for r in rows] == second.tolist()
    assert np.allclose([r.confidence for r in rows], confidence(exact.min(1), second), atol=1e-12)
    model = CentroidModel(c, 0.0, 1, "euclidean", "kmeans")
    assert [r.label for r in model.transform(df).orderBy("id").collect()] == want.tolist()
    scored = ClusterSnapshot(c, "euclidean").assign_with_scores(df).orderBy("id").collect()
    assert [r.label for r in scored] == want.tolist()
    assert np.allclose([r.confidence for r in scored], confidence(np.sqrt(exact.min(1)) ** 2, second), atol=1e-9) or np.allclose(
        [r.confidence for r in scored], confidence(np.sqrt(exact.min(1)), np.sqrt(second)), atol=1e-9
    )


class _Cluster:
    """As much of a session as the folder rule asks for."""

    def __init__(self, master, warehouse, default=None, checkpoint=None):
        made = []

        class Conf:
            def get(self, key, *fallback):
                return checkpoint if key == "spark.checkpoint.dir" else warehouse if key == "spark.sql.warehouse.dir" else default

        class Jsc:
            def hadoopConfiguration(self):
                return Conf()

        class Context:
            def getCheckpointDir(self):
                return made[-1] if made else None

            def setCheckpointDir(self, path):
                made.append(path)

        Context.master = master
        self.conf, self.sparkContext, self._jsc = Conf(), Context(), Jsc()


@pytest.mark.parametrize("warehouse,default", [("file:/data/warehouse", None), ("/data/warehouse", "file:///"), ("/data/warehouse", None)])
def test_no_intermediate_data_on_local_disks_of_a_cluster(warehouse, default):
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            durable.checkpoint_root(_Cluster(master, warehouse, default))


def test_shared_folders_are_taken():
    assert durable.checkpoint_root(_Cluster("yarn", "hdfs://n/w")) == "hdfs://n/w/_vecloom_checkpoint"
    assert durable.checkpoint_root(_Cluster("yarn", "/w", "hdfs://n")) == "/w/_vecloom_checkpoint"
    assert durable.checkpoint_root(_Cluster("yarn", "file:/w", None, "s3a://b/c/")) == "s3a://b/c"
    assert "vecloom-checkpoint-" in durable.checkpoint_root(_Cluster("local[4]", "file:/w"))
