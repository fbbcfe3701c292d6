import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import HDBSCAN
from vecloom.operators.condense import ClusterTree, condensed_frame, contract
from vecloom.operators.density import condensed_labels, spanning_tree
from vecloom.sources.tables import from_numpy


def edges_of(spark, edges):
    return spark.createDataFrame([(int(a), int(b), float(w)) for w, a, b in edges], "src long, dst long, weight double").repartition(4)


def both(spark, n, edges, size, method, compat, local_edges=0):
    """Labels, probabilities and stabilities of the array form and of the distributed one."""
    held = condensed_labels(n, edges, size, method, compat)
    frame, stability = condensed_frame(spark.range(n), edges_of(spark, edges), size, method, compat, local_edges)
    rows = frame.orderBy("id").collect()
    return held, (np.array([r.label for r in rows]), np.array([r.probability for r in rows]), stability)


def agree(a, b):
    assert a[0].tolist() == b[0].tolist()
    assert np.allclose(a[1], b[1], atol=1e-12) and np.allclose(a[2], b[2], rtol=1e-9)


def random_tree(n, seed, shape="random", ties=False):
    rng = np.random.default_rng(seed)
    weight = rng.integers(1, 6, n).astype(float) if ties else rng.random(n) + 0.01
    if shape == "path":
        return [(float(weight[i]), i, i + 1) for i in range(n - 1)]
    if shape == "falling":  # every row looks to the next: one long chain
        return [(float(n - i), i, i + 1) for i in range(n - 1)]
    if shape == "star":
        return [(float(weight[i]), 0, i) for i in range(1, n)]
    return [(float(weight[i]), min(i, j), max(i, j)) for i in range(1, n) for j in [int(rng.integers(0, i))]]


@pytest.mark.parametrize("shape,size,method,compat,ties", [("random", 3, "eom", True, True), ("falling", 2, "eom", False, False), ("star", 3, "leaf", True, True)])
def test_rounds_give_the_same_as_the_array_form(spark, shape, size, method, compat, ties):
    edges = random_tree(80, size, shape, ties)
    agree(*both(spark, 80, edges, size, method, compat))


@pytest.mark.parametrize("shape", ["random", "path", "falling", "star"])
def test_the_last_components_in_one_place(spark, shape):
    for size, method, compat, ties in ((3, "eom", True, False), (9, "leaf", False, True)):
        edges = random_tree(200, size, shape, ties)
        agree(*both(spark, 200, edges, size, method, compat, 10**6))


def test_rounds_first_and_the_rest_in_one_place(spark):
    edges = random_tree(150, 1)
    agree(*both(spark, 150, edges, 4, "eom", True, 60))


def test_every_row_enters_where_its_component_first_is_large(spark):
    edges = sorted(random_tree(90, 8, ties=True))
    want, members = {}, {i: {i} for i in range(90)}
    for rank, (_, a, b) in enumerate(edges):
        joined = members[a] | members[b]
        if len(joined) >= 4:
            want.update({i: rank for i in joined if i not in want})
        for i in joined:
            members[i] = joined
    for local_edges in (10**6, 0):
        entries(contract(spark.range(90), edges_of(spark, edges), 4, local_edges), want, edges)


def entries(found, want, edges):
    assert {r.id: r["rank"] for r in found.rows.collect()} == want
    assert found.merges.count() == found.births.count() - 1
    assert found.heaviest == max(w for w, *_ in edges)


def test_climbing_by_skip_pointers():
    rng = np.random.default_rng(3)
    for shape in ("chain", "random"):
        count = 60
        a = np.array([0 if shape == "chain" else int(rng.integers(0, i)) for i in range(1, count)])
        tree = ClusterTree(np.arange(count), np.arange(0, 3 * count - 3, 3), np.ones(count - 1), a, np.arange(1, count))
        seed, rank = rng.integers(0, count, 300), rng.integers(-1, 3 * count, 300)
        for s, r, got in zip(seed, rank, tree.clusters(seed, rank)):
            v = int(s)
            while tree.parent[v] != v and tree.rank[tree.parent[v]] < r:
                v = int(tree.parent[v])
            assert v == got


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_fit_without_the_matrix_gives_the_same_labels(spark, metric):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(np.roll([1, 6, 12], c), 0.4, (70, 3)) for c in range(3)] + [rng.uniform(-5, 15, (40, 3))])
    df = from_numpy(spark, x)
    a = HDBSCAN(8, metric=metric).fit(df)
    b = HDBSCAN(8, metric=metric, local_rows=1, block_rows=40).fit(df)
    rows = [[tuple(r) for r in m.labels_.join(m.probabilities_, "id").orderBy("id").collect()] for m in (a, b)]
    assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]] and len({r[1] for r in rows[0]}) > 2
    assert np.allclose([r[2] for r in rows[0]], [r[2] for r in rows[1]], atol=1e-6)
    assert np.allclose(a.cluster_persistence_, b.cluster_persistence_, rtol=1e-5)


def test_a_third_of_the_rows_equal(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([np.tile([[2.0, 2.0]], (60, 1)), rng.normal(2, 0.5, (60, 2)), rng.normal(9, 0.5, (60, 2))])
    df = from_numpy(spark, x)
    model = HDBSCAN(6, local_rows=1, block_rows=25).fit(df)
    label = np.array([r.label for r in model.labels_.orderBy("id").collect()])
    assert (label[:60] == label[0]).all() and label[0] >= 0
    assert (label[120:] >= 0).sum() > 40 and not set(label[120:]) & {label[0]} - {-1}


def test_too_few_rows_and_saving(spark, tmp_path):
    few = HDBSCAN(20, local_rows=1).fit(from_numpy(spark, np.arange(10.0)[:, None]))
    assert {r.label for r in few.labels_.collect()} == {-1}
    x = np.random.default_rng(1).normal(size=(60, 2))
    model = HDBSCAN(5, local_rows=1, block_rows=20).fit(from_numpy(spark, x))
    model.save(spark, str(tmp_path / "m"))
    again = HDBSCAN.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.labels_.collect())) == sorted(map(tuple, model.labels_.collect()))
    assert again.cluster_persistence_ == model.cluster_persistence_


@pytest.mark.parametrize("blocks", [0, 8])
def test_spanning_with_equal_rows_weighs_the_same(spark, monkeypatch, blocks):
    """In rounds, and in one task."""
    from vecloom.operators import neighbors
    from vecloom.operators.neighbors import core_distances, reachability_tree
    from vecloom.plans.frames import feature_frame

    monkeypatch.setattr(neighbors, "SPANNED_BLOCKS", blocks)
    rng = np.random.default_rng(2)
    x = np.vstack([np.repeat(rng.normal(size=(5, 3)), 9, axis=0), rng.normal(size=(45, 3)), np.zeros((4, 3))])
    frame = feature_frame(from_numpy(spark, x))
    for metric in ("euclidean", "cosine"):
        cored = frame.join(core_distances(frame, len(x), 4, metric), "id")
        tree = reachability_tree(cored, len(x), metric, block_rows=20)
        held = spanning_tree(x, 4, metric)
        assert tree.count() == len(x) - 1
        assert sorted(r.weight for r in tree.collect()) == pytest.approx(sorted(w for w, *_ in held), abs=1e-9)
        assert tree.where(F.col("src") == F.col("dst")).isEmpty()
