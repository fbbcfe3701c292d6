import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import test_density_metrics as plain
from tests.test_density_metrics import labels
from vecloom.operators import pivots
from vecloom.operators.agglomerative import AgglomerativeClustering
from vecloom.operators.density import DBSCAN, spanning_tree
from vecloom.operators.neighbors import _within, core_distances, knn_join, range_join, reachability_tree
from vecloom.operators.pivots import PivotCells
from vecloom.plans.components import joined_roots, numbered
from vecloom.plans.frames import feature_frame
from vecloom.sources.tables import from_numpy


def distances(x, metric="euclidean"):
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(plain.distances(x, metric), nan=1.0)  # a zero row is at cosine distance 1 from all


def groups_of(seed, groups, each, d, spread=0.05):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(0, 3, (groups, d)), each, axis=0) + rng.normal(0, spread, (groups * each, d))


def awkward(metric):
    """Groups, 40 equal rows (a hot cell), far outliers; for cosine zero rows and one of vanishing length."""
    x = np.vstack([groups_of(3, 8, 12, 6), np.full((40, 6), 0.5), np.eye(6) * 50])
    if metric == "cosine":
        x = np.vstack([x, np.zeros((7, 6)), np.full((1, 6), 1e-80)])
    return x


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_joins_on_awkward_rows(spark, metric):
    x = awkward(metric)
    n = len(x)
    d = distances(x, metric)
    frame = feature_frame(from_numpy(spark, x)).cache()
    radius = 0.02 if metric == "cosine" else 0.4
    got = {(r.src, r.dst) for r in range_join(frame, n, 6, radius, metric, block_rows=16).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= radius}
    np.fill_diagonal(d, np.inf)
    rows = knn_join(frame, n, 4, metric, block_rows=16).collect()
    far = {(r.src, r["rank"]): r.distance for r in rows}
    assert len(rows) == 4 * n and len({(r.src, r.dst) for r in rows}) == 4 * n
    assert all(far[i, k + 1] == pytest.approx(np.sort(d[i])[k], abs=1e-9) for i in range(n) for k in range(4))
    if metric == "euclidean":  # equal rows: the smallest other ids
        ties = {r.src: set() for r in rows}
        for r in rows:
            ties[r.src].add(r.dst)
        assert ties[100] == {96, 97, 98, 99} and ties[96] == {97, 98, 99, 100}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_trees_on_awkward_rows(spark, metric):
    x = awkward(metric)
    frame = feature_frame(from_numpy(spark, x)).cache()
    cored = frame.join(core_distances(frame, len(x), 3, metric, block_rows=16), "id")
    tree = reachability_tree(cored, len(x), metric, block_rows=16).collect()
    want = spanning_tree(x, 3, metric)
    assert len(tree) == len(x) - 1 and np.allclose(sorted(r["weight"] for r in tree), sorted(e[0] for e in want), atol=1e-7)


def plain_dbscan(x, eps, least, metric):
    near = distances(x, metric) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    label, count = np.full(len(x), -1), 0
    for i in np.nonzero(core)[0]:
        if label[i] < 0:
            stack, label[i] = [i], count
            while stack:
                for j in np.nonzero(near[stack.pop()] & core & (label < 0))[0]:
                    label[j] = count
                    stack.append(j)
            count += 1
    for i in np.nonzero(~core)[0]:
        next_to = label[near[i] & core]
        label[i] = next_to.min() if len(next_to) else -1
    return label, core


@pytest.mark.parametrize("metric,eps,least", [("euclidean", 0.2, 4), ("euclidean", 0.15, 5), ("cosine", 0.0005, 3), ("cosine", 0.001, 1)])
@pytest.mark.parametrize("block_rows", [16, 2048])
def test_dbscan_on_awkward_rows(spark, metric, eps, least, block_rows):
    x = awkward(metric)[:-1]  # the vanishing row's own products underflow in the plain version
    label, core = plain_dbscan(x, eps, least, metric)
    model = DBSCAN(eps, least, metric, block_rows=block_rows).fit(from_numpy(spark, x))
    assert labels(model.labels_).tolist() == label.tolist()
    assert {r["id"] for r in model.core_sample_indices_.collect()} == set(np.nonzero(core)[0].tolist())


def test_rows_visit_a_bounded_number_of_cells(spark):
    """With twice the groups of the same kind a row still meets its own surroundings only."""
    visits = []
    for groups in (20, 40):
        x = groups_of(5, groups, 50, 8)
        cells = PivotCells(feature_frame(from_numpy(spark, x)), len(x), "euclidean", 100)
        visits.append(_within(cells, cells.rows, 0.1, both_ways=True).agg(F.avg(F.size("targets"))).first()[0])
        assert visits[-1] < len(cells.pivots) / 3
    assert visits[1] < 1.6 * visits[0]


def test_copies_are_not_compared_with_each_other(spark):
    x = np.vstack([np.zeros((3000, 4)), groups_of(1, 5, 20, 4)])
    frame = feature_frame(from_numpy(spark, x))
    cells = PivotCells(frame, len(x), "euclidean", 64)
    assert cells.keep_copies(4).where(F.col("id") < 3000).count() == 4
    model = DBSCAN(0.3, 5, block_rows=64).fit(from_numpy(spark, x))
    found = labels(model.labels_)
    assert set(found[:3000]) == {0} and len(set(found[3000:])) >= 5


def test_bounds_hold_far_from_the_origin(spark, monkeypatch):
    x = groups_of(7, 12, 10, 5) + 1e9
    monkeypatch.setattr(pivots, "PIVOTS", 12)
    frame = feature_frame(from_numpy(spark, x))
    d = distances(x)
    got = {(r.src, r.dst) for r in range_join(frame, 120, 5, 0.2, block_rows=10).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= 0.2}


def test_single_linkage_beyond_the_matrix(spark):
    x = groups_of(11, 4, 15, 3)
    model = AgglomerativeClustering(4, "single", max_rows=10, block_rows=12).fit(from_numpy(spark, x))
    found = labels(model.labels_)
    assert all(len(set(found[15 * g : 15 * g + 15])) == 1 for g in range(4)) and len(set(found)) == 4


def test_numbers_and_roots(spark):
    ids = np.random.default_rng(0).permutation(1000)[:300]
    df = spark.createDataFrame([(int(i),) for i in ids], "c long").repartition(5)
    assert {r["c"]: r["k"] for r in numbered(df, "c", "k").collect()} == {int(c): k for k, c in enumerate(sorted(ids))}
    assert numbered(df.limit(0), "c", "k").count() == 0
    a, b = np.array([5, 1, 7, 3]), np.array([6, 5, 3, 7])
    assert joined_roots(np.arange(8), a, b).tolist() == [0, 1, 2, 3, 4, 1, 1, 3]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_joins_over_split_cells(spark, monkeypatch, metric):
    """Four top cells for over a hundred rows: nearly all comparisons go through leaves."""
    monkeypatch.setattr(pivots, "PIVOTS", 4)
    x = awkward(metric)
    n, d = len(x), distances(x, metric)
    frame = feature_frame(from_numpy(spark, x)).cache()
    cells = PivotCells(frame, n, metric, 8)
    assert cells.inner.any() and cells.sizes[~cells.inner].sum() == n and (cells.parent >= 0).sum() > 4
    radius = 0.02 if metric == "cosine" else 0.4
    got = {(r.src, r.dst) for r in range_join(frame, n, 6, radius, metric, block_rows=8).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= radius}
    np.fill_diagonal(d, np.inf)
    rows = knn_join(frame, n, 4, metric, block_rows=8).collect()
    far = {(r.src, r["rank"]): r.distance for r in rows}
    assert len(rows) == 4 * n
    assert all(far[i, k + 1] == pytest.approx(np.sort(d[i])[k], abs=1e-9) for i in range(n) for k in range(4))


def test_trees_and_wards_over_split_cells(spark, monkeypatch):
    from vecloom.operators.agglomerative import merged

    monkeypatch.setattr(pivots, "PIVOTS", 4)
    x = awkward("euclidean")
    frame = feature_frame(from_numpy(spark, x)).cache()
    cored = frame.join(core_distances(frame, len(x), 3, "euclidean", block_rows=8), "id")
    tree = reachability_tree(cored, len(x), "euclidean", block_rows=8).collect()
    assert sorted(r.weight for r in tree) == pytest.approx(sorted(w for w, *_ in spanning_tree(x, 3, "euclidean")), abs=1e-9)
    y = groups_of(2, 6, 12, 3)
    held, far = (AgglomerativeClustering(5, "ward", max_rows=m, block_rows=8).fit(from_numpy(spark, y)) for m in (100, 20))
    a, b = labels(held.labels_), labels(far.labels_)
    assert len(set(zip(a, b))) == 5


def test_leaves_stay_small_and_visits_few_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PIVOTS", 16)
    visits = []
    for groups in (30, 300):
        x = groups_of(6, groups, 40, 6)
        cells = PivotCells(feature_frame(from_numpy(spark, x)), len(x), "euclidean", 60)
        leaves = cells.sizes[~cells.inner & (cells.sizes > 0)]
        assert leaves.mean() < 120 and leaves.max() < 1000, (leaves.mean(), leaves.max())
        seen = _within(cells, cells.rows, 0.1, both_ways=True)
        visits.append(seen.groupBy("id").agg(F.sum(F.size("targets")).alias("n")).agg(F.avg("n")).first()[0])
    assert visits[1] < 2 * visits[0]


def test_boxes_close_cells_that_balls_leave_open(spark):
    """Rows along one line: balls round them reach far to the side, boxes do not."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.uniform(0, 100, 4000), rng.normal(0, 0.01, 4000)])
    y = np.vstack([x, x + [0, 3.0]])
    cells = PivotCells(feature_frame(from_numpy(spark, y)), len(y), "euclidean", 200)
    seen = _within(cells, cells.rows, 0.05, both_ways=True)
    low, high = cells.bounds()(y)
    balls = ((low <= 0.05) & np.isfinite(low)).sum(1).mean()
    assert seen.agg(F.avg(F.size("targets"))).first()[0] < 0.9 * balls
