import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import DBSCAN, HDBSCAN
from vecloom.operators import metrics as M
from vecloom.operators.density import condensed_labels, spanning_tree
from vecloom.operators.neighbors import core_distances, knn_join, range_join, reachability_tree
from vecloom.plans.components import connected_components
from vecloom.plans.frames import feature_frame
from vecloom.sources.tables import from_columns, from_numpy, read, write


def labels(df):
    return np.array([r["label"] for r in df.orderBy("id").collect()])


def distances(x, metric="euclidean"):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return 1 - u @ u.T
    gap = x[:, None] - x[None]
    return np.abs(gap).sum(2) if metric == "manhattan" else np.sqrt((gap**2).sum(2))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("d", [2, 5])
def test_range_join_against_brute_force(spark, metric, d):
    x = np.random.default_rng(d).normal(size=(150, d))
    near = distances(x, metric)
    radius = float(np.quantile(near, 0.05)) + 1e-9  # not exactly at a pair
    frame = feature_frame(from_numpy(spark, x))
    got = {(r.src, r.dst): r.distance for r in range_join(frame, 150, d, radius, metric, block_rows=40).collect()}
    want = {(i, j): near[i, j] for i in range(150) for j in range(i + 1, 150) if near[i, j] <= radius}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_knn_and_core_distances(spark):
    x = np.random.default_rng(1).normal(size=(120, 4))
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    frame = feature_frame(from_numpy(spark, x))
    rows = knn_join(frame, 120, 3, block_rows=30).collect()
    assert {(r.src, r["rank"]): r.dst for r in rows} == {(i, k + 1): int(np.argsort(d[i], kind="stable")[k]) for i in range(120) for k in range(3)}
    core = {r["id"]: r["core"] for r in core_distances(frame, 120, 4, block_rows=50).collect()}
    assert all(core[i] == pytest.approx(np.sort(d[i])[3]) for i in range(120))


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {v: find(v) for v in parent}
    assert got == {r["node"]: r["component"] for r in connected_components(df, local_edges=10_000).collect()}
    assert connected_components(df.where("false")).collect() == []


def plain_dbscan(x, eps, least, metric):
    near = distances(x, metric) <= eps
    core = near.sum(1) >= least
    label, current = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = current
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in np.nonzero(near[p])[0]:
                if label[q] == -1:
                    label[q] = current
                    stack.append(q)
        current += 1
    return label, core


@pytest.mark.parametrize("metric,d", [("euclidean", 2), ("manhattan", 2), ("euclidean", 6), ("cosine", 3)])
def test_dbscan_against_a_plain_walk(spark, metric, d):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.4, (40, d)) for c in (0, 2, 5)] + [rng.uniform(-3, 8, (25, d))])
    eps = {"euclidean": 0.5 * d**0.5, "manhattan": 0.7, "cosine": 0.01}[metric]
    model = DBSCAN(eps, 4, metric, block_rows=60).fit(from_numpy(spark, x))
    want, core = plain_dbscan(x, eps, 4, metric)
    assert (labels(model.labels_) == want).all()
    assert sorted(r["id"] for r in model.core_sample_indices_.collect()) == np.nonzero(core)[0].tolist()
    assert model.components_.count() == core.sum()


def test_dbscan_edges(spark):
    df = from_numpy(spark, np.array([[0.0, 0.0], [0.0, 0.0], [9.0, 9.0]]))
    assert labels(DBSCAN(0.5, 1).fit(df).labels_).tolist() == [0, 0, 1]
    assert labels(DBSCAN(0.5, 3).fit(df).labels_).tolist() == [-1, -1, -1]
    chain = from_numpy(spark, np.array([[0.4 * k, 0.0] for k in range(30)]))
    assert set(labels(DBSCAN(0.5, 2).fit(chain).labels_)) == {0}
    for bad in (dict(eps=0), dict(eps=float("inf")), dict(min_samples=0)):
        with pytest.raises(ValueError):
            DBSCAN(**bad)


def test_spanning_trees_weigh_the_same(spark):
    x = np.random.default_rng(9).normal(size=(90, 3))
    held = spanning_tree(x, 4, "euclidean")
    frame = feature_frame(from_numpy(spark, x))
    cored = frame.join(core_distances(frame, 90, 4), "id")
    tree = reachability_tree(cored, 90, block_rows=25).collect()
    assert len(tree) == len(held) == 89
    assert np.allclose(sorted(r["weight"] for r in tree), sorted(e[0] for e in held))


def two_blobs(seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 0.3, (30, 2)), rng.normal(10, 0.3, (30, 2))])


@pytest.mark.parametrize("method", ["eom", "leaf"])
@pytest.mark.parametrize("local_rows", [4096, 10])
def test_hdbscan(spark, method, local_rows):
    x = np.vstack([two_blobs(), [[50.0, -50.0]]])
    model = HDBSCAN(8, cluster_selection_method=method, local_rows=local_rows, block_rows=40).fit(from_numpy(spark, x))
    found = labels(model.labels_)
    assert found[-1] == -1
    a, b = set(found[:30]) - {-1}, set(found[30:60]) - {-1}
    assert a and b and not a & b
    p = np.array([r["probability"] for r in model.probabilities_.orderBy("id").collect()])
    assert ((p >= 0) & (p <= 1)).all() and (p[found == -1] == 0).all()
    assert len(model.cluster_persistence_) == len(set(found) - {-1})


def test_condensing_small_trees():
    path = [(1.0, 0, 1), (1.0, 1, 2), (5.0, 2, 3), (1.0, 3, 4), (1.0, 4, 5)]
    label, p, stability = condensed_labels(6, path, 3, "eom", True)
    assert label.tolist() == [0, 0, 0, 1, 1, 1] and np.allclose(p, 1) and np.allclose(stability, [3 * 0.8, 3 * 0.8])
    assert set(condensed_labels(6, path, 4, "eom", True)[0].tolist()) == {0}
    assert condensed_labels(1, [], 2, "eom", True)[0].tolist() == [-1]
    same = [(0.0, 0, 1), (0.0, 1, 2), (0.0, 2, 3)]
    assert np.isfinite(condensed_labels(4, same, 2, "leaf", False)[1]).all()


def test_hdbscan_edges(spark):
    df = from_numpy(spark, np.zeros((3, 2)))
    assert set(labels(HDBSCAN(5).fit(df).labels_)) == {-1}
    for bad in (dict(min_cluster_size=1), dict(min_samples=0), dict(cluster_selection_method="x"), dict(metric="x")):
        with pytest.raises(ValueError):
            HDBSCAN(**bad)


def plain_silhouette(x, y, d):
    out = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean() if own.any() else 0.0
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def test_quality_against_plain_formulas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = np.array([0] * 40 + [1] * 25 + [2] * 14 + [4])
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(99, [9.0, 9.0, 9.0], -1)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label long")
    assert M.silhouette_score(df, block_rows=30) == pytest.approx(plain_silhouette(x, y, distances(x)))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(u, y))], "id long, features array<double>, label long")
    assert M.cosine_silhouette(unit) == pytest.approx(plain_silhouette(u, y, distances(u, "cosine")))
    assert M.cosine_silhouette_samples(unit, sample_size=20).count() < 60
    centres = {c: x[y == c].mean(0) for c in set(y)}
    between = sum((y == c).sum() * ((m - x.mean(0)) ** 2).sum() for c, m in centres.items())
    within = sum(((x[y == c] - m) ** 2).sum() for c, m in centres.items())
    assert M.calinski_harabasz_score(df) == pytest.approx((between / 3) / (within / 76))
    s = {c: np.linalg.norm(x[y == c] - m, axis=1).mean() for c, m in centres.items()}
    worst = [max((s[a] + s[b]) / np.linalg.norm(centres[a] - centres[b]) for b in s if b != a) for a in s]
    assert M.davies_bouldin_score(df) == pytest.approx(np.mean(worst))


def test_quality_edges(spark):
    noise = spark.createDataFrame([(1, [1.0], -1)], "id long, features array<double>, label long")
    assert M.davies_bouldin_score(noise) == 0.0
    for f in (M.silhouette_score, M.calinski_harabasz_score):
        with pytest.raises(ValueError):
            f(noise)
    one = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], "id long, features array<double>, label long")
    assert M.silhouette_score(one) == M.calinski_harabasz_score(one) == M.davies_bouldin_score(one) == M.cosine_silhouette(one) == 0.0
    tight = spark.createDataFrame([(i, [float(i // 2)], i // 2) for i in range(4)], "id long, features array<double>, label long")
    assert M.calinski_harabasz_score(tight) == float(np.finfo(float).max)
    same = spark.createDataFrame([(i, i % 2, "ab"[i % 2]) for i in range(10)], "id long, label long, truth string")
    assert M.purity(same).first()[0] == 1 and M.nmi(same).first()[0] == pytest.approx(1) and M.ari(same).first()[0] == 1
    assert M.label_agreement(same, "label", "truth") == 1.0
    table = spark.createDataFrame([(0, 0)] * 5 + [(0, 1)] * 4 + [(1, 0)] * 4, "label long, truth long")
    assert M.label_agreement(table, "label", "truth") == pytest.approx(8 / 13)
    assert M.label_agreement(table, "label", "truth", exact_up_to=1) == pytest.approx(5 / 13)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3), (2, None, 4)], "k long, a double, b int")
    for kind in ("parquet", "orc", "json", "csv"):
        write(df, str(tmp_path / kind), kind)
        back = read(spark, str(tmp_path / kind), kind, schema=df.schema)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    vectors = from_columns(df, ["a", "b"], "k").orderBy("id").collect()
    assert vectors[0]["features"] == [2.0, 3.0] and vectors[1]["features"] is None
    assert from_numpy(spark, np.ones((1, 2), np.float32)).schema["features"].dataType.elementType.typeName() == "float"
    with pytest.raises(ValueError):
        read(spark, "x", "avro-ish")


def test_core_queries_match_their_sql(spark):
    """Every core query that has SQL; those of the optional subpackage are tested beside it."""
    import os

    import duckdb

    import __spark_entry__
    from vecloom import queries as core

    sf_dir = "/root/testdata/sf0.001"
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(core.QUERIES) <= set(queries)
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    plain = lambda row: tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in row)
    for name in core.ORACLE_SQL:
        df = queries[name](spark, sf_dir)
        got = con.execute(sql[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(plain, got.fetchall()), key=repr) == sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=repr), name
    assert __spark_entry__.entry(spark).count() == 500
    assert queries["drift_report_global"](spark, sf_dir).agg(F.sum("n_samples")).first()[0] == 500
