import pickle

import numpy as np
import pytest

from tests.test_density_metrics import labels, two_blobs
from vecloom import DBSCAN, HDBSCAN, AgglomerativeClustering
from vecloom.plans.frames import NotFittedError
from vecloom.sources.tables import from_numpy


@pytest.mark.parametrize("model", [DBSCAN(1.0, 4), HDBSCAN(8, cluster_selection_method="leaf"), AgglomerativeClustering(3, "average"), AgglomerativeClustering(3, "single", max_rows=20, block_rows=30), AgglomerativeClustering(3, "ward", max_rows=20, block_rows=30)])
def test_fitted_models_come_back(spark, tmp_path, model):
    model.fit(from_numpy(spark, two_blobs()))
    model.save(spark, str(tmp_path / "m"))
    again = type(model).load(spark, str(tmp_path / "m"))
    assert repr(again) == repr(model) and labels(again.labels_).tolist() == labels(model.labels_).tolist()
    if isinstance(model, DBSCAN):
        assert again.components_.count() == model.components_.count()
    if isinstance(model, HDBSCAN):
        assert again.cluster_persistence_ == model.cluster_persistence_
        assert {tuple(r) for r in again.probabilities_.collect()} == {tuple(r) for r in model.probabilities_.collect()}
    if isinstance(model, AgglomerativeClustering):
        assert again.children_ == [tuple(c) for c in model.children_] and np.allclose(again.distances_, model.distances_)
    with pytest.raises(TypeError):
        pickle.dumps(model)


def test_models_that_are_not_fitted(spark, tmp_path):
    DBSCAN(0.25, 7).save(spark, str(tmp_path / "m"))
    again = DBSCAN.load(spark, str(tmp_path / "m"))
    assert (again.eps, again.min_samples) == (0.25, 7)
    with pytest.raises(NotFittedError):
        again.labels_
    with pytest.raises(ValueError):
        HDBSCAN.load(spark, str(tmp_path / "m"))
    assert repr(pickle.loads(pickle.dumps(again))) == repr(again)
