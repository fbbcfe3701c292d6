import pickle

import numpy as np
import pytest

from vecloom import EmbeddingCluster
from vecloom.plans.frames import NotFittedError
from vecloom.sources.tables import from_numpy


def mixture(d=16):
    rng = np.random.default_rng(42)
    centres = np.eye(3, d)
    return np.repeat(centres, 60, axis=0) + rng.normal(0, 0.1, (180, d))


@pytest.mark.parametrize("reduction", ["pca", "matryoshka", "none"])
def test_saved_and_pickled_models_assign_as_before(spark, tmp_path, reduction):
    df = from_numpy(spark, mixture())
    model = EmbeddingCluster(3, 4, n_init=2, reduction=reduction).fit(df).refine_vmf(max_iter=5)
    want = [r.label for r in model.labels_.orderBy("id").collect()]
    assert [r.label for r in model.predict(df).orderBy("id").collect()] == want
    model.save(spark, str(tmp_path / "m"))
    for again in (EmbeddingCluster.load(spark, str(tmp_path / "m")), pickle.loads(pickle.dumps(model))):
        assert [r.label for r in again.predict(df).orderBy("id").collect()] == want
        assert np.allclose(again.cluster_centers_, model.cluster_centers_) and again.inertia_ == pytest.approx(model.inertia_)
        for name in ("vmf_means_", "vmf_weights_", "concentrations_", "intra_similarity_", "resultant_lengths_"):
            assert np.allclose(getattr(again, name), getattr(model, name))
        assert (again.bic_, again.objective_, again.n_iter_) == (model.bic_, model.objective_, model.n_iter_)
        a, b = again.snapshot(), model.snapshot()
        assert a.sizes == b.sizes == [60, 60, 60] and np.allclose(a.fit_mean, b.fit_mean) and a.input_dim == 16
        with pytest.raises(NotFittedError):
            again.representatives_
        with pytest.raises(NotFittedError):
            again.labels_
    loaded = EmbeddingCluster.load(spark, str(tmp_path / "m"))
    assert loaded.telemetry_.count() == model.telemetry_.count()
    assert loaded.fit(df).labels_.count() == 180


def test_models_without_a_mixture_or_a_fit(spark, tmp_path):
    with pytest.raises(NotFittedError):
        EmbeddingCluster(3).save(spark, str(tmp_path / "n"))
    assert pickle.loads(pickle.dumps(EmbeddingCluster(3))).n_clusters == 3
    model = EmbeddingCluster(3, None, n_init=1).fit(from_numpy(spark, mixture()))
    model.save(spark, str(tmp_path / "k"))
    loaded = EmbeddingCluster.load(spark, str(tmp_path / "k"))
    assert loaded.concentrations_ is None and loaded.bic_ is None and loaded.reducer is None
    with pytest.raises(NotFittedError):
        loaded.soft_assign()
