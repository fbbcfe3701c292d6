import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import AgglomerativeClustering, ClusterSnapshot, EmbeddingCluster, EmbeddingReducer, HierarchicalSnapshot, KMeans, MiniBatchKMeans
from vecloom.operators.agglomerative import merged
from vecloom.operators.assign import nearest_two
from vecloom.operators.embedding import responsibilities
from vecloom.operators.kmeans import CentroidModel
from vecloom.plans.frames import NotFittedError
from vecloom.sources.tables import from_numpy


def blobs(n=50, gap=20.0, spread=0.5, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, spread, (n, 2)), rng.normal(gap, spread, (n, 2))])


def labels(df):
    return np.array([r["label"] for r in df.orderBy("id").collect()])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("local_bytes", [1 << 20, 0])
def test_kmeans_finds_blobs_held_or_distributed(spark, metric, local_bytes):
    x = blobs() if metric != "cosine" else np.vstack([blobs(30, 0, 0.1)[:30] + [1, 0], blobs(30, 0, 0.1)[:30] + [0, 1]])
    model = KMeans(2, n_init=2, metric=metric, local_bytes=local_bytes).fit(from_numpy(spark, x))
    assert same_partition(labels(model.labels_), np.repeat([0, 1], len(x) // 2))


def test_distributed_rounds_equal_local_ones(spark):
    df = from_numpy(spark, np.random.default_rng(1).normal(size=(400, 5))).repartition(5)
    a = KMeans(6, max_iter=7, tol=0, init="first_k").fit(df)
    b = KMeans(6, max_iter=7, tol=0, init="first_k", local_bytes=0).fit(df)
    assert np.allclose(a.cluster_centers_, b.cluster_centers_) and a.inertia_ == pytest.approx(b.inertia_) and a.n_iter_ == b.n_iter_ == 7


def plain_lloyd(x, k, rounds):
    c = x[:k].copy()
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        label, cost = d.argmin(1), d.min(1).sum()
        c = np.array([x[label == j].mean(0) if (label == j).any() else x[len(x) - 1 - d.min(1)[::-1].argmax()] for j in range(k)])
    return c, cost


def test_lloyd_against_plain_loop(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    model = KMeans(5, max_iter=4, tol=0, init="first_k").fit(from_numpy(spark, x))
    c, cost = plain_lloyd(x, 5, 4)
    assert np.allclose(model.cluster_centers_, c) and model.inertia_ == pytest.approx(cost)


def test_kmeans_edges(spark):
    x = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    df = from_numpy(spark, x)
    assert np.allclose(KMeans(1).fit(df).cluster_centers_, [[3, 4]])
    assert KMeans(3, n_init=1).fit(df).inertia_ == 0
    same = from_numpy(spark, np.ones((6, 2)))
    assert KMeans(2, n_init=1).fit(same).inertia_ == 0
    for bad in (dict(n_clusters=0), dict(n_clusters=2, max_iter=0), dict(n_clusters=2, tol=-1), dict(n_clusters=2, metric="x"), dict(n_clusters=2, algorithm="x")):
        with pytest.raises(ValueError):
            KMeans(**bad)
    for rows in ([], [[float("nan"), 1.0]], [[float("inf"), 1.0]], [[1.0, 2.0], [1.0]]):
        frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, features array<double>")
        with pytest.raises(ValueError):
            KMeans(1).fit(frame)
    with pytest.raises(ValueError):
        KMeans(4).fit(df)
    with pytest.raises(ValueError):
        from_numpy(spark, np.ones(3))
    with pytest.raises(NotFittedError):
        KMeans(2).predict(df)
    ints = spark.createDataFrame([(i, [i, 0]) for i in range(4)], "id long, features array<int>")
    assert KMeans(2, n_init=1).fit(ints).inertia_ == 1.0


def test_restarts_never_hurt_and_pickle(spark, tmp_path):
    df = from_numpy(spark, np.random.default_rng(3).normal(size=(200, 3)))
    one, many = KMeans(8, n_init=1, random_state=5).fit(df), KMeans(8, n_init=6, random_state=5).fit(df)
    assert many.inertia_ <= one.inertia_ + 1e-9
    again = pickle.loads(pickle.dumps(many))
    assert np.array_equal(again.cluster_centers_, many.cluster_centers_)
    many.save(spark, str(tmp_path / "m"))
    loaded = CentroidModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(loaded.cluster_centers_, many.cluster_centers_)
    assert (labels(loaded.transform(df)) == labels(many.labels_)).all()


def test_nearest_two_against_brute_force():
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(200, 7)), rng.normal(size=(20, 7))
    for metric in ("euclidean", "cosine", "manhattan", "dot"):
        label, best, second = nearest_two(x, c, metric)
        for i in range(200):
            d = {"euclidean": ((c - x[i]) ** 2).sum(1), "manhattan": np.abs(c - x[i]).sum(1), "dot": -(c @ x[i]), "cosine": 1 - c @ x[i] / np.linalg.norm(c, axis=1) / np.linalg.norm(x[i])}[metric]
            o = np.argsort(d, kind="stable")
            assert label[i] == o[0] and best[i] == pytest.approx(d[o[0]]) and second[i] == pytest.approx(d[o[1]])
    label, best, second = nearest_two(np.array([[1.0, 1.0]]), np.array([[0.0, 0.0], [5.0, 5.0], [10.0, 0.0]]), "euclidean")
    assert (label[0], best[0], second[0]) == (0, 2, 32)
    assert nearest_two(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1.0]]), "euclidean")[0][0] == 0
    assert nearest_two(np.array([[np.nan, 0.0]]), np.array([[1.0, 0], [0, 1.0]]), "euclidean")[0][0] == 0


def test_minibatch(spark):
    x = blobs(200)
    model = MiniBatchKMeans(2, batch_size=64, max_iter=20).fit(from_numpy(spark, x))
    assert same_partition(labels(model.labels_), np.repeat([0, 1], 200)) and model.n_iter_ == 20
    early = MiniBatchKMeans(2, batch_size=64, max_iter=100, tol=0.5, max_no_improvement=3).fit(from_numpy(spark, x))
    assert early.n_iter_ < 100
    far = MiniBatchKMeans(2, batch_size=64, max_iter=5, local_bytes=0).fit(from_numpy(spark, x))
    assert same_partition(labels(far.labels_), np.repeat([0, 1], 200))
    with pytest.raises(ValueError):
        MiniBatchKMeans(2, batch_size=0)


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_agglomerative(spark, linkage):
    x = blobs(20, 10, 0.3)
    model = AgglomerativeClustering(2, linkage).fit(from_numpy(spark, x))
    assert same_partition(labels(model.labels_), np.repeat([0, 1], 20))
    assert len(model.children_) == 38 and (np.diff(model.distances_) > -1e-9).all()


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_merges_against_a_naive_loop(linkage):
    x = np.random.default_rng(6).normal(size=(25, 3))
    groups = {i: [i] for i in range(25)}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def gap(a, b):
        block = d[np.ix_(a, b)]
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return {"complete": block.max(), "single": block.min(), "average": block.mean()}[linkage]

    heights = []
    while len(groups) > 3:
        h, i, j = min((gap(groups[i], groups[j]), i, j) for i in groups for j in groups if i < j)
        heights.append(h)
        groups[i] += groups.pop(j)
    got, _, found = merged(x, 3, linkage, "euclidean")
    want = np.zeros(25, int)
    for k, g in enumerate(groups.values()):
        want[g] = k
    assert np.allclose(found, heights) and same_partition(got, want)


def test_single_linkage_by_spanning_tree(spark):
    x = np.random.default_rng(8).normal(size=(60, 2))
    held = AgglomerativeClustering(4, "single").fit(from_numpy(spark, x))
    cut = AgglomerativeClustering(4, "single", max_rows=10, block_rows=20).fit(from_numpy(spark, x))
    assert same_partition(labels(held.labels_), labels(cut.labels_)) and np.allclose(held.distances_, cut.distances_)
    assert [tuple(map(int, c)) for c in held.children_] == cut.children_
    with pytest.raises(ValueError):
        AgglomerativeClustering(2, "ward", "cosine")
    with pytest.raises(ValueError):
        AgglomerativeClustering(2, "unknown", max_rows=10).fit(from_numpy(spark, x))


def directions(n=100, k=3, d=24, seed=42):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(k, d))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return np.vstack([c[j] + 0.05 * rng.normal(size=(n, d)) for j in range(k)]), np.repeat(np.arange(k), n)


def test_pca_and_truncation(spark, tmp_path):
    x, _ = directions()
    df = from_numpy(spark, x)
    reducer = EmbeddingReducer(4).fit(df)
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:4]
    assert np.allclose(np.abs(np.sum(axes * reducer.components.T, axis=1)), 1, atol=1e-6)
    out = np.array([r["reduced"] for r in reducer.transform(df).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(out, axis=1), 1)
    reducer.save(spark, str(tmp_path / "r"))
    again = np.array([r["reduced"] for r in EmbeddingReducer.load(spark, str(tmp_path / "r")).transform(df).orderBy("id").collect()])
    assert np.allclose(out, again)
    short = EmbeddingReducer(6, "matryoshka").fit_transform(df).orderBy("id").first()["reduced"]
    assert np.allclose(short, x[0, :6] / np.linalg.norm(x[0, :6]))
    with pytest.raises(ValueError):
        EmbeddingReducer(99).fit(df)
    with pytest.raises(NotFittedError):
        EmbeddingReducer(2).transform(df)


@pytest.mark.parametrize("reduction", ["pca", "matryoshka", "none"])
def test_embedding_cluster_and_vmf(spark, reduction):
    x, truth = directions()
    model = EmbeddingCluster(3, reduction_dim=8, n_init=3, reduction=reduction, local_bytes=0 if reduction == "pca" else 1 << 24).fit(from_numpy(spark, x))
    assert same_partition(labels(model.labels_), truth)
    assert np.allclose(np.linalg.norm(model.cluster_centers_, axis=1), 1) and (model.intra_similarity_ > 0.8).all()
    assert sorted(r["label"] for r in model.representatives_.collect()) == [0, 1, 2]
    assert model.telemetry_.where("run = 0").count() >= 2
    model.refine_vmf(max_iter=10)
    p = np.array([r["probabilities"] for r in model.soft_assign().orderBy("id").collect()])
    assert np.allclose(p.sum(1), 1) and same_partition(p.argmax(1), truth) and (model.concentrations_ > 1).all() and np.isfinite(model.bic_)


def test_embedding_minibatch_and_responsibilities(spark):
    x, truth = directions()
    model = EmbeddingCluster(3, reduction="none", n_init=4, algorithm="minibatch", max_iter=30, batch_size=80).fit(from_numpy(spark, x))
    assert len(set(labels(model.labels_))) == 3
    p, loglik = responsibilities(np.eye(3), np.eye(3), np.full(3, 50.0), np.full(3, 1 / 3))
    assert np.allclose(p.argmax(1), [0, 1, 2]) and np.isfinite(loglik)


def snapshot_of(spark, n=100):
    x = blobs(n, 10, 0.3, 42)
    df = from_numpy(spark, x)
    model = KMeans(2, n_init=2, random_state=42).fit(df)
    return x, df, model, model.snapshot()


def test_snapshot_scores_match_predict_and_survive_saving(spark, tmp_path):
    x, df, model, snapshot = snapshot_of(spark)
    assert (labels(snapshot.assign(df)) == labels(model.transform(df))).all()
    snapshot.calibrate(df).save(spark, str(tmp_path / "s"))
    again = ClusterSnapshot.load(spark, str(tmp_path / "s"))
    a, b = (s.assign_with_scores(df, adaptive_threshold=True, adaptive_percentile="p25").orderBy("id").collect() for s in (snapshot, again))
    assert a == b and again.is_calibrated and again.k == 2 and again.d == 2
    rejected = np.mean([r["rejected"] for r in a])
    assert 0.2 < rejected < 0.3 and all((r["label"] == -1) == r["rejected"] for r in a)
    all_gone = snapshot.assign_with_scores(df, confidence_threshold=1.1).where("label >= 0")
    assert all_gone.count() == 0
    with pytest.raises(ValueError):
        snapshot.assign_with_scores(df, adaptive_threshold=True, adaptive_percentile="p7")
    with pytest.raises(ValueError):
        ClusterSnapshot([[0.0, 0.0]]).assign(df, boundary_mode="mahalanobis")
    with pytest.raises(Exception, match="dimensions"):
        ClusterSnapshot([[0.0, 0.0, 0.0]]).assign(df).collect()


def test_mahalanobis_prefers_the_wide_cluster(spark):
    snapshot = ClusterSnapshot([[0.0, 0.0], [10.0, 0.0]])
    snapshot.variances = np.array([[1.0, 100.0], [1.0, 1.0]])
    row = snapshot.assign_with_scores(from_numpy(spark, [[5.0, 8.0]]), boundary_mode="mahalanobis").first()
    assert row["label"] == 0 and row["distance"] == pytest.approx(25.64)


def test_drift(spark):
    x, df, model, snapshot = snapshot_of(spark)
    report = snapshot.drift_report(df)
    assert sum(r["new_size"] for r in report.clusters.collect()) == 200 and report.overall.first()["rejection_rate"] == 0
    assert all(np.isnan(r["relative_drift"]) for r in report.clusters.collect())
    v, _ = directions()
    sphere = EmbeddingCluster(3, reduction="none", n_init=2).fit(from_numpy(spark, v)).snapshot().calibrate(from_numpy(spark, v))
    same = sphere.drift_report(from_numpy(spark, v)).clusters.collect()
    noise = sphere.drift_report(from_numpy(spark, np.random.default_rng(99).normal(size=v.shape))).clusters.collect()
    assert max(abs(r["direction_drift"]) for r in same) < 1e-9 and min(r["direction_drift"] for r in noise) > 0.05
    assert min(abs(r["kappa_drift"]) for r in noise) > 0.5
    assert sphere.drift_report(from_numpy(spark, v)).overall.first()["rejection_rate"] == 1.0
    assert sphere.drift_report(from_numpy(spark, v), compat=False).overall.first()["rejection_rate"] == 0.0


def test_drift_rules(spark):
    """Rejection by the mean over clusters, direction against the centroid, whatever was calibrated."""
    x = np.vstack([np.tile([0.0, 1.0], (3, 1)), np.tile([10.0, 3.0], (2, 1))])  # squared distances 1 and 9
    for means, n, want in (([1.0, 3.0], 5, 0.4), ([0.1, 9.0], 5, 0.0), ([0.4, 0.0], 5, 1.0), ([0.0, 0.0], 5, 0.0), ([0.4, 0.0], 0, 0.0)):
        snapshot = ClusterSnapshot([[0.0, 0.0], [10.0, 0.0]], fit_mean=means, n_fitted=n)
        assert snapshot.drift_report(from_numpy(spark, x)).overall.first()["rejection_rate"] == pytest.approx(want), means
    turned = np.array([[np.cos(t), np.sin(t)] for t in (0.1, 0.3)])
    sphere = ClusterSnapshot([[1.0, 0.0], [-1.0, 0.0]], spherical=True, fit_mean=[0.3, 0.1], sizes=[1, 1]).calibrate(from_numpy(spark, turned))
    row = sphere.drift_report(from_numpy(spark, turned)).clusters.orderBy("label").first()
    assert row["direction_drift"] == pytest.approx(1 - np.cos(0.2)) and row["kappa_drift"] == pytest.approx(0)
    assert sphere.drift_report(from_numpy(spark, turned)).overall.first()["rejection_rate"] == 0.0  # none below 2 * 0.2


def test_calibration_percentiles_are_exact(spark):
    from vecloom.operators.snapshot import unit_percentiles

    rng = np.random.default_rng(1)
    rows = [(0, float(v)) for v in rng.random(501)] + [(1, float(v)) for v in rng.choice([0.0, 0.25, 1.0], 300)] + [(2, 0.5)] + [(3, float(v)) for v in 0.4 + 1e-7 * rng.random(200)]
    got = unit_percentiles(spark.createDataFrame(rows, "label long, v double").repartition(3), [0.05, 0.1, 0.25, 0.5])
    for j in range(4):
        assert np.allclose(got[j], np.percentile([v for k, v in rows if k == j], [5, 10, 25, 50]), rtol=0, atol=1e-15)


def test_spherical_minibatch_blends_resultants(spark):
    from vecloom.operators.embedding import spherical_minibatch_step

    c = np.array([[1.0, 0.0], [0.0, 1.0]])
    batches = [np.array([[0.6, 0.8], [0.8, 0.6], [0.0, 1.0]]), np.array([[1.0, 0.0], [0.28, 0.96]])]
    centres, resultants, counts = c, c.copy(), np.ones(2)
    want, plain, seen = c.copy(), [c[0].copy(), c[1].copy()], [1.0, 1.0]
    for x in batches:
        label = (x @ want.T).argmax(1)
        n, total = np.bincount(label, minlength=2).astype(float), np.array([x[label == j].sum(0) for j in range(2)])
        centres, resultants, counts = spherical_minibatch_step(centres, resultants, counts, n, total)
        for j in range(2):
            if n[j]:
                rate = n[j] / (seen[j] + n[j])
                seen[j] += n[j]
                plain[j] = (1 - rate) * plain[j] + rate * total[j]
                want[j] = plain[j] / np.linalg.norm(plain[j])
        assert np.allclose(centres, want) and np.allclose(counts, seen)
    assert not np.allclose(resultants, centres)


def test_churn_is_counted_and_ends_the_rounds(spark):
    x, _ = directions()
    for local_bytes in (0, 1 << 24):
        model = EmbeddingCluster(3, reduction="none", n_init=1, local_bytes=local_bytes).fit(from_numpy(spark, x))
        rounds = model.telemetry_.orderBy("iteration").collect()
        assert rounds[0]["churn"] == 1.0 and all(r["churn"] < 1e-3 for r in rounds[-2:])
        assert len(rounds) == model.model.n_iter_


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(50, 8)) * 0.05
    x = c[rng.integers(0, 50, 400)] + rng.normal(size=(400, 8)) * 0.02
    from vecloom.operators.assign import nearest_one

    for offset in (0.0, 1e6, 1e7):
        y, d = x + offset, c + offset
        want = ((y[:, None] - d[None]) ** 2).sum(2)
        label, best, second = nearest_two(y, d, "euclidean")
        assert (label == want.argmin(1)).all() and np.allclose(best, want.min(1)) and np.allclose(second, np.sort(want, axis=1)[:, 1])
        one, near = nearest_one(y, d, "euclidean")
        assert (one == label).all() and np.allclose(near, best)
    shifted = EmbeddingReducer(3).fit(from_numpy(spark, x + 1e6)).components
    assert np.allclose(np.abs((shifted * EmbeddingReducer(3).fit(from_numpy(spark, x)).components).sum(0)), 1, atol=1e-4)


def test_hierarchy(spark, tmp_path):
    rng = np.random.default_rng(5)
    # children are fitted on the sphere, so sub-clusters differ by direction
    x = np.vstack([rng.normal([a + b, a - b], 0.3, (30, 2)) for a in (20, 60, 120) for b in (-6, 6)])
    df = from_numpy(spark, x)
    tree = HierarchicalSnapshot.build(df, KMeans(3, n_init=4).fit(df), 2, random_state=3, n_init=2)
    assert tree.k_root == 3 and tree.n_children == 3
    tree.save(spark, str(tmp_path / "h"))
    for t in (tree, HierarchicalSnapshot.load(spark, str(tmp_path / "h"))):
        rows = t.assign(df).orderBy("id").collect()
        assert same_partition([(r["root_label"], r["child_label"]) for r in rows], np.repeat(np.arange(6), 30).tolist())
    assert all(child.spherical and child.reducer is None for child in tree.children.values())
    none = tree.assign_with_scores(df, confidence_threshold=1.1).first()
    assert none["root_rejected"] and none["child_rejected"] and none["child_label"] == -1
    for child in tree.children.values():
        child.calibrate(df)
    tree.root.calibrate(df)
    scored = tree.assign_with_scores(df, adaptive_threshold=True, adaptive_percentile="p50")
    rows = scored.orderBy("id").collect()
    kept = [r for r in rows if not r["root_rejected"]]
    assert any(r["child_rejected"] for r in kept) and any(not r["child_rejected"] for r in kept)
    assert all((r["child_label"] == -1) == r["child_rejected"] and r["rejected"] == (r["root_rejected"] or r["child_rejected"]) for r in rows)
    lonely = HierarchicalSnapshot(tree.root, {}).assign_with_scores(df).first()
    assert lonely["child_label"] == -1 and lonely["child_rejected"] and lonely["child_confidence"] == 0


def test_null_vectors_and_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, [0.0, 0.0], "b")], "id long, features array<double>, note string")
    out = ClusterSnapshot([[0.0, 1.0]]).assign_with_scores(df).orderBy("id").collect()
    assert out[0]["label"] is None and out[1]["label"] == 0 and [r["note"] for r in out] == ["a", "b"]
    with pytest.raises(ValueError):
        ClusterSnapshot([[0.0, 1.0]]).assign(df.withColumn("Label", F.lit(1)))
