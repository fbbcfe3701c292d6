"""Rows that leave most cells open: compared in sweeps, with the results of the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_density_metrics import labels
from tests.test_pivots import awkward, distances, plain_dbscan
from vecloom.operators import neighbors, pivots, sweep
from vecloom.operators import metrics as M
from vecloom.operators.density import DBSCAN, components_within, spanning_tree
from vecloom.operators.neighbors import core_distances, knn_join, range_join, reachability_tree
from vecloom.plans.frames import feature_frame
from vecloom.sources.tables import from_numpy

METRICS = ["euclidean", "manhattan", "cosine"]


@pytest.fixture
def swept(monkeypatch):
    monkeypatch.setattr(pivots, "OPEN_CELLS", -1)
    monkeypatch.setattr(pivots, "VISITED_BYTES", 0)
    monkeypatch.setattr(sweep, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(sweep, "PIECES", 2)


def noise(n=300, d=6):
    return np.random.default_rng(8).normal(size=(n, d))


@pytest.mark.parametrize("metric,kind", [("euclidean", awkward), ("manhattan", awkward), ("cosine", awkward), ("euclidean", lambda metric: noise())])
def test_joins_in_sweeps(spark, swept, metric, kind):
    x = kind(metric)
    n, d = len(x), distances(x, metric)
    radius = 0.02 if metric == "cosine" else 1.1
    frame = feature_frame(from_numpy(spark, x)).withColumn("twice", F.col("id") * 2)
    rows = range_join(frame, n, 6, radius, metric, block_rows=16, given=("twice",)).collect()
    assert len(rows) == len({(r.src, r.dst) for r in rows}) and all(r.a_twice == 2 * r.src and r.b_twice == 2 * r.dst for r in rows)
    assert {(r.src, r.dst) for r in rows} == {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= radius}
    linked = {r["id"]: r["component"] for r in components_within(frame, n, 6, radius, metric, block_rows=16).collect()}
    near = d <= radius
    for i in range(n):
        assert all(linked[i] == linked[j] for j in np.nonzero(near[i])[0]) and linked[linked[i]] == linked[i] <= i
    np.fill_diagonal(d, np.inf)
    rows = knn_join(frame.drop("twice"), n, 4, metric, block_rows=16).collect()
    far = {(r.src, r["rank"]): r.distance for r in rows}
    assert len(rows) == 4 * n and len({(r.src, r.dst) for r in rows}) == 4 * n
    assert all(far[i, k + 1] == pytest.approx(np.sort(d[i])[k], abs=1e-9) for i in range(n) for k in range(4))


def test_given_columns_without_sweeps(spark):
    x = noise(60)
    for cut in (2, 6):
        frame = feature_frame(from_numpy(spark, x[:, :cut])).withColumn("twice", F.col("id") * 2)
        rows = range_join(frame, 60, cut, 1.5, block_rows=16, given=("twice",)).collect()
        assert rows and all(r.a_twice == 2 * r.src and r.b_twice == 2 * r.dst for r in rows)


@pytest.mark.parametrize("metric,kind,listed", [("euclidean", awkward, 2), ("cosine", awkward, 16), ("euclidean", lambda metric: noise(), 2)])
def test_trees_in_sweeps(spark, swept, monkeypatch, metric, kind, listed):
    monkeypatch.setattr(neighbors, "SPANNED_BLOCKS", 0)
    monkeypatch.setattr(neighbors, "LISTED", listed)
    x = kind(metric)
    frame = feature_frame(from_numpy(spark, x)).cache()
    tree = reachability_tree(frame.join(core_distances(frame, len(x), 3, metric, block_rows=16), "id"), len(x), metric, block_rows=16).collect()
    want = spanning_tree(x, 3, metric)
    assert len({(r.src, r.dst) for r in tree}) == len(tree) == len(x) - 1
    assert np.allclose(sorted(r["weight"] for r in tree), sorted(e[0] for e in want), atol=1e-7)


@pytest.mark.parametrize("metric,eps,least", [("euclidean", 0.2, 4), ("cosine", 0.0005, 3), ("cosine", 0.001, 1), ("euclidean", 0.001, 90)])
def test_dbscan_in_sweeps(spark, swept, metric, eps, least):
    x = awkward(metric)[: -1 if metric == "cosine" else None]
    label, core = plain_dbscan(x, eps, least, metric)
    model = DBSCAN(eps, least, metric, block_rows=16).fit(from_numpy(spark, x))
    assert labels(model.labels_).tolist() == label.tolist()
    assert {r["id"] for r in model.core_sample_indices_.collect()} == set(np.nonzero(core)[0].tolist())


def test_silhouettes_in_several_chunks(spark, swept):
    x = np.vstack([noise(90), np.zeros((5, 6)), noise(40) + 1e6])
    y = np.array([0, 1, 2] * 45)
    d = distances(x)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    got = {r["id"]: r["silhouette"] for r in M.silhouette_samples(spark.createDataFrame(rows, "id long, features array<double>, label long")).collect()}
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean(), min(d[i, y == c].mean() for c in {0, 1, 2} - {y[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-8)


def test_rows_are_written_once_not_for_every_cell(spark, monkeypatch):
    """Vectors without structure leave all cells open; rows in small groups do not."""
    monkeypatch.setattr(pivots, "VISITED_BYTES", 0)
    frame = lambda x: feature_frame(from_numpy(spark, x))
    groups = np.repeat(np.random.default_rng(2).normal(0, 9, (40, 12)), 50, axis=0) + noise(2000, 12) * 0.01
    for x, crowded in ((noise(2000, 40), True), (groups, False)):
        cells = pivots.PivotCells(frame(x), len(x), "euclidean", 64)
        assert cells.crowded(cells.rows, neighbors._reaching(cells, 0.2 if not crowded else 6.0), ("cell",)) == crowded


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("scale", [1e-25, 1.0, 1e12, 1e25])
def test_pairs_in_doubt_are_measured(monkeypatch, metric, scale):
    """The product in single precision only tells which pairs to measure."""
    monkeypatch.setattr(sweep, "RUN_ROWS", 32)
    monkeypatch.setattr(sweep, "TILE_ROWS", 24)
    x = np.vstack([noise(100), noise(50) + 1e6, noise(50)[::-1] * 1e-3 + 5]) * scale
    d = distances(x, metric)
    raw = d * d if metric == "euclidean" else d
    limit = float(np.median(raw[:100, :100])) * (1 + 1e-7)
    chunk = sweep.Chunk(x, {}, metric)
    got = {(int(i), int(j)) for p, q, _ in chunk.within(x, limit) for i, j in zip(p, q)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(raw <= limit))}


def test_grid_joins_are_never_built_on_the_driver(spark):
    """A small file may hold many rows: the grid's side was broadcast, nine rows for each."""
    x = np.random.default_rng(4).uniform(0, 1, size=(200, 2))
    found = range_join(feature_frame(from_numpy(spark, x)), 200, 2, 0.1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == int((distances(x) <= 0.1).sum() - 200) // 2
