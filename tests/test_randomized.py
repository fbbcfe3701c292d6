import numpy as np
import pytest

from vecloom import EmbeddingCluster, EmbeddingReducer
from vecloom.operators import reduce as R
from vecloom.sources.tables import from_numpy


def decaying(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * (1 / np.arange(1, d + 1)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 5


def test_axes_are_those_of_the_exact_form(spark):
    df = from_numpy(spark, decaying(400, 30)).repartition(4)
    exact, fast = EmbeddingReducer(6).fit(df), EmbeddingReducer(6, "randomized").fit(df)
    assert np.allclose(exact.explained_variance_, fast.explained_variance_, rtol=1e-3)
    assert np.allclose(fast.components.T @ fast.components, np.eye(6), atol=1e-9) and np.allclose(exact.mean, fast.mean)
    assert np.allclose(np.abs((exact.components * fast.components).sum(0)), 1, atol=1e-3)
    a, b = (sorted(map(str, np.round(m.transform(df).toPandas().sort_values("id")["reduced"].tolist(), 2).tolist())) for m in (exact, fast))
    assert len(a) == len(b) == 400


def test_slow_decay_keeps_the_variance(spark):
    x = np.random.default_rng(1).normal(size=(600, 40)) * np.linspace(1.5, 1, 40)
    exact, fast = (EmbeddingReducer(8, m).fit(from_numpy(spark, x)) for m in ("pca", "randomized"))
    assert fast.explained_variance_.sum() > 0.99 * exact.explained_variance_.sum()


def test_nothing_of_the_size_of_a_covariance(spark, monkeypatch):
    """20,000 dimensions: a covariance would take 3.2 GB."""
    monkeypatch.setattr(R, "POWER_PASSES", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 20_000)) + 0.01 * rng.normal(size=(60, 20_000))
    model = EmbeddingReducer(3, "randomized").fit(from_numpy(spark, x))
    off = x - x.mean(0)
    want = np.linalg.svd(off, compute_uv=False)[:3] ** 2 / 59
    assert model.components.shape == (20_000, 3) and np.allclose(model.explained_variance_, want, rtol=0.01)


def test_saved_and_used_by_embedding_clusters(spark, tmp_path):
    df = from_numpy(spark, decaying(120, 12, 3))
    model = EmbeddingReducer(4, "randomized").fit(df)
    model.save(spark, str(tmp_path / "r"))
    again = EmbeddingReducer.load(spark, str(tmp_path / "r"))
    assert again.method == "randomized" and np.allclose(again.components, model.components)
    assert EmbeddingCluster(3, 4, n_init=1, reduction="randomized").fit(df).labels_.count() == 120
    with pytest.raises(ValueError):
        EmbeddingReducer(4, "random")
