"""The registered queries over the driver tables, with DuckDB SQL that gives the same rows.

Vectors come from ``embeddings`` (64 dimensions); models with fixed parameters use the rows of the
smallest ids as centroids, so that SQL can follow.  Figures are rounded to 9 places (6 where sums over
many rows meet) in both.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import metrics as M
from vecloom.operators.agglomerative import AgglomerativeClustering
from vecloom.operators.assign import assign, assign_with_scores
from vecloom.operators.condense import contract
from vecloom.operators.density import DBSCAN, HDBSCAN, components_within
from vecloom.operators.embedding import EmbeddingCluster, e_step_sums, spherical_minibatch_step
from vecloom.operators.hierarchy import HierarchicalSnapshot
from vecloom.operators.kmeans import KMeans, MiniBatchKMeans, minibatch_step
from vecloom.operators.lloyd import SparkRows
from vecloom.operators.neighbors import core_distances, knn_join, range_join, reachability_tree
from vecloom.operators.reduce import EmbeddingReducer
from vecloom.operators.snapshot import ClusterSnapshot
from vecloom.plans.durable import checkpoint_root, materialize
from vecloom.plans.frames import feature_frame, matrix_of, validate
from vecloom.sources.arrays import read_arrays, write_arrays
from vecloom.sources.tables import from_columns

QUERIES = {}
ORACLE_SQL = {}
K = 8
EPS = 1.15


def query(sql: str | None = None):
    """Registers a function as a query of its name, and its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features, truth)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("truth"))


def seeds(frame: DataFrame, k: int = K) -> np.ndarray:
    """The k rows of the smallest ids as a matrix."""
    return matrix_of(frame.orderBy("id").limit(k).select("features").toArrow().column("features").combine_chunks())


def r9(c):
    return F.round(c, 9)


# --- SQL building blocks -------------------------------------------------------------------------

E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label AS truth FROM embeddings)"
SEEDS = "c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS c FROM e ORDER BY id LIMIT {k})"


def s_sum(body: str) -> str:
    return f"coalesce(list_sum({body}), 0.0)"


def s_dot(a: str, b: str) -> str:
    return s_sum(f"list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])")


def s_sq(a: str, b: str) -> str:
    return s_sum(f"list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))")


def s_norm2(a: str) -> str:
    return s_sum(f"list_transform({a}, lambda v: v * v)")


def s_unit(a: str) -> str:
    return f"list_transform({a}, lambda v: v * (1 / sqrt({s_norm2(a)})))"


def s_scored(k: int = K, source: str = "e", centroids: str = "c") -> str:
    """s(id, truth, x, cid, d, second, conf) by squared distance to the k centroids."""
    return f"""pairs AS (SELECT p.id, p.truth, p.x, c.cid, {s_sq('p.x', 'c.c')} AS d FROM {source} p, {centroids} c),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r, lead(d) OVER (PARTITION BY id ORDER BY d, cid) AS second FROM pairs),
    s AS (SELECT id, truth, x, cid, d, second, CASE WHEN abs(second) >= 1e-30 THEN 1 - greatest(0, least(1, d / second)) ELSE 0 END AS conf FROM ranked WHERE r = 1)"""


FIRST = SEEDS.format(k=K)

# --- vector functions ------------------------------------------------------------------------------


@query(f"WITH {E} SELECT id, round(u[1], 9) AS first, round(u[64], 9) AS last, round({s_norm2('u')}, 9) AS norm2 FROM (SELECT id, {s_unit('y')} AS u FROM (SELECT id, list_transform(x, lambda v: v * 3) AS y FROM e))")
def vec_l2_normalize(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("id", V.l2_normalize(F.transform("features", lambda v: v * 3)).alias("u"))
    return rows.select("id", r9(F.element_at("u", 1)).alias("first"), r9(F.element_at("u", 64)).alias("last"), r9(V.norm2(F.col("u"))).alias("norm2"))


@query(f"WITH {E} SELECT id, CAST(len(u) AS INTEGER) AS size, round(u[1], 9) AS first, round(u[16], 9) AS last FROM (SELECT id, {s_unit('y')} AS u FROM (SELECT id, x[1:16] AS y FROM e))")
def vec_truncate(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("id", V.truncate(F.col("features"), 16).alias("u"))
    return rows.select("id", F.size("u").alias("size"), r9(F.element_at("u", 1)).alias("first"), r9(F.element_at("u", 16)).alias("last"))


@query(f"""WITH {E} SELECT id, CAST(len(u) AS INTEGER) AS size, round(u[1], 9) AS first, round(u[64], 9) AS last FROM (SELECT id, {s_unit('y')} AS u FROM
    (SELECT id, list_concat(list_transform(x[1:32], lambda v: v * sqrt(2)), list_transform(x[33:64], lambda v: v * sqrt(0.5))) AS y FROM e))""")
def vec_fuse_views(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    fused = rows.select("id", V.fuse_views(F.slice("features", 1, 32), F.slice("features", 33, 32), 2.0, 0.5).alias("u"))
    return fused.select("id", F.size("u").alias("size"), r9(F.element_at("u", 1)).alias("first"), r9(F.element_at("u", 64)).alias("last"))


def _against_first(spark, sf_dir, value):
    rows = embeddings(spark, sf_dir)
    one = rows.orderBy("id").limit(1).select(F.col("features").alias("other"))
    return rows.join(F.broadcast(one)).select("id", r9(value(F.col("features"), F.col("other"))).alias("value"))


def _first_sql(value: str) -> str:
    return f"WITH {E}, o AS (SELECT x AS y FROM e ORDER BY id LIMIT 1) SELECT id, round({value}, 9) AS value FROM e, o"


@query(_first_sql(f"sqrt({s_sq('x', 'y')})"))
def vec_distance_euclidean(spark, sf_dir):
    return _against_first(spark, sf_dir, lambda a, b: F.sqrt(V.squared_euclidean(a, b)))


@query(_first_sql(f"1 - {s_dot('x', 'y')} / sqrt({s_norm2('x')} * {s_norm2('y')})"))
def vec_distance_cosine(spark, sf_dir):
    return _against_first(spark, sf_dir, V.cosine_distance)


@query(_first_sql(s_sum("list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))")))
def vec_distance_manhattan(spark, sf_dir):
    return _against_first(spark, sf_dir, V.manhattan)


@query(_first_sql(s_dot("x", "y")))
def vec_dot(spark, sf_dir):
    return _against_first(spark, sf_dir, V.dot)


@query(f"WITH {E}, o AS (SELECT x AS y FROM e ORDER BY id LIMIT 1) SELECT id, round(acos(greatest(-1, least(1, {s_dot('x', 'y')}))), 9) AS value FROM e, o")
def vec_angle(spark, sf_dir):
    return _against_first(spark, sf_dir, V.angular)


@query(f"WITH {E}, o AS (SELECT x AS y FROM e ORDER BY id LIMIT 1) SELECT id, round({s_sq('x', 'y')}, 9) AS d, round({s_norm2('x')}, 9) AS n FROM e, o WHERE {s_dot('x', 'y')} > 0")
def vec_sql_functions(spark, sf_dir):
    """The functions as registered for SQL."""
    V.register_sql_functions(spark)
    embeddings(spark, sf_dir).createOrReplaceTempView("vecloom_embeddings")
    return spark.sql(
        """SELECT /*+ BROADCAST(o) */ id, round(vec_squared_euclidean(features, y), 9) AS d, round(vec_norm2(features), 9) AS n
        FROM vecloom_embeddings, (SELECT features AS y FROM vecloom_embeddings ORDER BY id LIMIT 1) o WHERE vec_dot(features, y) > 0"""
    )


# --- assignment, rejection, calibration, drift ---------------------------------------------------


@query(f"WITH {E}, {FIRST}, {s_scored()} SELECT id, cid AS label FROM s")
def assign_nearest(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return assign(rows, seeds(rows)).select("id", "label")


@query(f"WITH {E}, {FIRST}, {s_scored()} SELECT id, CASE WHEN conf < 0.02 THEN -1 ELSE cid END AS label, round(d, 9) AS distance, round(second, 9) AS second_distance, round(conf, 9) AS confidence, conf < 0.02 AS rejected FROM s")
def assign_top2_scores(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    out = ClusterSnapshot(seeds(rows)).assign_with_scores(rows, confidence_threshold=0.02)
    return out.select("id", "label", *[r9(c).alias(c) for c in ("distance", "second_distance", "confidence")], "rejected")


@query(f"""WITH {E}, {FIRST}, p AS (SELECT e.id, c.cid, {s_dot('e.x', 'c.c')} AS d FROM e, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, cid) AS r, lead(d) OVER (PARTITION BY id ORDER BY d DESC, cid) AS second FROM p)
    SELECT id, cid AS label, round(d, 9) AS distance, round(second, 9) AS second_distance FROM r WHERE r = 1""")
def assign_max_dot(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return assign_with_scores(rows, seeds(rows), "dot").select("id", "label", r9("distance").alias("distance"), r9("second_distance").alias("second_distance"))


VARIANCES = """v AS (SELECT cid, list(greatest(coalesce(v, 1e-12), 1e-12) ORDER BY i) AS v FROM
    (SELECT cid, i, var_samp(x[i]) AS v FROM s, range(1, 65) t(i) GROUP BY cid, i) GROUP BY cid)"""


@query(f"""WITH {E}, {FIRST}, {s_scored()}, {VARIANCES},
    m AS (SELECT e.id, c.cid, {s_sum('list_transform(list_zip(e.x, c.c, v.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3])')} AS d FROM e, c JOIN v USING (cid)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r FROM m) SELECT id, cid AS label, round(d, 6) AS distance FROM r WHERE r = 1""")
def assign_mahalanobis(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    snapshot = ClusterSnapshot(seeds(rows)).calibrate(rows)
    return snapshot.assign_with_scores(rows, boundary_mode="mahalanobis").select("id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {E}, {FIRST}, {s_scored()} SELECT id, CASE WHEN d > 1.6 OR conf < 0.05 THEN -1 ELSE cid END AS label, (d > 1.6 OR conf < 0.05) AS rejected FROM s")
def reject_global(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return ClusterSnapshot(seeds(rows)).assign_with_scores(rows, distance_threshold=1.6, confidence_threshold=0.05).select("id", "label", "rejected")


@query(f"""WITH {E}, {FIRST}, {s_scored()}, q AS (SELECT cid, quantile_cont(conf, 0.25) AS p FROM s GROUP BY cid)
    SELECT id, CASE WHEN d > 1.9 OR conf < p THEN -1 ELSE cid END AS label, (d > 1.9 OR conf < p) AS rejected FROM s JOIN q USING (cid)""")
def reject_adaptive(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    snapshot = ClusterSnapshot(seeds(rows)).calibrate(rows)
    return snapshot.assign_with_scores(rows, distance_threshold=1.9, adaptive_threshold=True, adaptive_percentile="p25").select("id", "label", "rejected")


@query(f"""WITH {E}, {FIRST}, {s_scored()} SELECT cid AS label, round(quantile_cont(conf, 0.05), 9) AS p5, round(quantile_cont(conf, 0.1), 9) AS p10,
    round(quantile_cont(conf, 0.25), 9) AS p25, round(quantile_cont(conf, 0.5), 9) AS p50 FROM s GROUP BY cid""")
def calibrate_percentiles(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    p = ClusterSnapshot(seeds(rows)).calibrate(rows).confidence_percentiles
    out = spark.createDataFrame([(j, *map(float, row)) for j, row in enumerate(p)], "label long, p5 double, p10 double, p25 double, p50 double")
    return out.select("label", *[r9(c).alias(c) for c in ("p5", "p10", "p25", "p50")])


@query(f"WITH {E}, {FIRST}, {s_scored()} SELECT cid AS label, i AS dim, round(greatest(coalesce(var_samp(x[i]), 1e-12), 1e-12), 9) AS variance FROM s, range(1, 65) t(i) GROUP BY cid, i")
def calibrate_variance(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    v = ClusterSnapshot(seeds(rows)).calibrate(rows).variances
    out = spark.createDataFrame([(j, k + 1, float(x)) for j, row in enumerate(v) for k, x in enumerate(row)], "label long, dim long, variance double")
    return out.withColumn("variance", r9("variance"))


SPHERE = f"""u AS (SELECT id, {s_unit('x')} AS x, truth FROM e), c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS c FROM u ORDER BY id LIMIT {K}),
    p AS (SELECT u.id, u.x, c.cid, {s_dot('u.x', 'c.c')} AS d FROM u, c), s AS (SELECT id, x, cid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, cid) AS r FROM p) WHERE r = 1)"""


DRIFT_MEANS = [0.02 + 0.02 * j for j in range(K)]


def _sphere(rows: DataFrame) -> ClusterSnapshot:
    centres = seeds(rows)
    return ClusterSnapshot(centres / np.linalg.norm(centres, axis=1, keepdims=True), spherical=True, sizes=[1] * K, fit_mean=DRIFT_MEANS)


def _kappa_sql(source: str = "s") -> str:
    return f"""(SELECT cid, r * (64 - r * r) / greatest(1 - r * r, 1e-10) AS kappa FROM (SELECT cid, sqrt(sum(m * m)) AS r FROM
        (SELECT cid, i, avg(x[i]) AS m FROM {source}, range(1, 65) t(i) GROUP BY cid, i) GROUP BY cid))"""


@query(f"WITH {E}, {SPHERE} SELECT cid AS label, round(kappa, 6) AS kappa FROM {_kappa_sql()}")
def calibrate_kappa(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    kappas = _sphere(rows).calibrate(rows).kappas
    return spark.createDataFrame([(j, round(float(k), 6)) for j, k in enumerate(kappas)], "label long, kappa double")


def _turned(rows: DataFrame) -> DataFrame:
    """The same rows with their components in reverse, as new rows that have drifted."""
    return rows.withColumn("features", F.reverse("features"))


@query(f"""WITH {E}, {SPHERE}, p1 AS (SELECT u.id, list_reverse(u.x) AS x, c.cid, {s_dot('list_reverse(u.x)', 'c.c')} AS d FROM u, c),
    s1 AS (SELECT id, x, cid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, cid) AS r FROM p1) WHERE r = 1),
    a AS (SELECT cid, count(*) AS n, avg(d) AS m, 0.02 + 0.02 * cid AS f FROM s1 GROUP BY cid), k0 AS {_kappa_sql()}, k1 AS {_kappa_sql('s1')},
    dirs AS (SELECT cid, 1 - {s_dot('any_value(c)', 'list(m ORDER BY i)')} / sqrt(sum(m * m)) AS direction FROM (SELECT cid, i, avg(x[i]) AS m FROM s1, range(1, 65) t(i) GROUP BY cid, i) JOIN c USING (cid) GROUP BY cid)
    SELECT c.cid AS label, coalesce(n, 0) AS new_size, round(coalesce(m, 0), 9) AS new_mean_distance, round((coalesce(m, 0) - (0.02 + 0.02 * c.cid)) / (0.02 + 0.02 * c.cid), 6) AS relative_drift,
    round((k1.kappa - k0.kappa) / k0.kappa, 6) AS kappa_drift, round(direction, 6) AS direction_drift FROM c LEFT JOIN a USING (cid) LEFT JOIN k0 USING (cid) LEFT JOIN k1 USING (cid) LEFT JOIN dirs USING (cid)""")
def drift_report_clusters(spark, sf_dir):
    """All rows calibrate, all rows with reversed components are the new ones; means differ by cluster."""
    rows = embeddings(spark, sf_dir)
    out = _sphere(rows).calibrate(rows).drift_report(_turned(rows)).clusters
    return out.select("label", "new_size", r9("new_mean_distance").alias("new_mean_distance"), *[F.round(c, 6).alias(c) for c in ("relative_drift", "kappa_drift", "direction_drift")])


@query(f"""WITH {E}, {FIRST}, w AS (SELECT id, truth, list_reverse(x) AS x FROM e), {s_scored(source='w')}
    SELECT round(avg(d), 6) AS global_mean_distance, round(avg(CASE WHEN d > 2 * (0.5 + 0.1 * 3.5) THEN 1.0 ELSE 0.0 END), 6) AS rejection_rate, count(*) AS n_samples FROM s""")
def drift_report_global(spark, sf_dir):
    """New rows beyond twice the mean over clusters of unequal fitted means."""
    rows = embeddings(spark, sf_dir)
    out = ClusterSnapshot(seeds(rows), sizes=[1] * K, fit_mean=[0.5 + 0.1 * j for j in range(K)]).drift_report(_turned(rows)).overall
    return out.select(F.round("global_mean_distance", 6).alias("global_mean_distance"), F.round("rejection_rate", 6).alias("rejection_rate"), "n_samples")


@query(f"""WITH {E}, {SPHERE}, p1 AS (SELECT u.id, max({s_dot('list_reverse(u.x)', 'c.c')}) AS d FROM u, c GROUP BY u.id)
    SELECT round(avg(d), 6) AS global_mean_distance, round(avg(CASE WHEN d < 2 * (0.02 + 0.02 * 3.5) THEN 1.0 ELSE 0.0 END), 6) AS rejection_rate, count(*) AS n_samples FROM p1""")
def drift_report_spherical(spark, sf_dir):
    """The same for similarities: rows below twice that mean."""
    rows = embeddings(spark, sf_dir)
    out = _sphere(rows).drift_report(_turned(rows)).overall
    return out.select(F.round("global_mean_distance", 6).alias("global_mean_distance"), F.round("rejection_rate", 6).alias("rejection_rate"), "n_samples")


@query(f"""WITH {E}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS n, x AS c FROM e ORDER BY id LIMIT 10),
    near AS (SELECT e.id, c.n, CASE WHEN n < 4 THEN -1 WHEN n < 7 THEN 0 ELSE 1 END AS owner, {s_sq('e.x', 'c.c')} AS d FROM e, c),
    best AS (SELECT id, owner, arg_min(n, (d, n)) AS n FROM near GROUP BY id, owner), root AS (SELECT id, n AS root FROM best WHERE owner = -1)
    SELECT root.id, root AS root_label, coalesce(CASE WHEN root = 0 THEN n - 4 ELSE n - 7 END, -1) AS child_label FROM root LEFT JOIN best ON best.id = root.id AND best.owner = root""")
def hier_assign(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    c = seeds(rows, 10)
    tree = HierarchicalSnapshot(ClusterSnapshot(c[:4]), {0: ClusterSnapshot(c[4:7]), 1: ClusterSnapshot(c[7:])})
    return tree.assign(rows).select("id", "root_label", "child_label")


@query(f"""WITH {E}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS n, x AS c FROM e ORDER BY id LIMIT 10),
    near AS (SELECT e.id, c.n, CASE WHEN n < 4 THEN -1 WHEN n < 7 THEN 0 ELSE 1 END AS owner, {s_sq('e.x', 'c.c')} AS d FROM e, c),
    ranked AS (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS second FROM near WINDOW w AS (PARTITION BY id, owner ORDER BY d, n)),
    best AS (SELECT id, owner, CASE owner WHEN -1 THEN n WHEN 0 THEN n - 4 ELSE n - 7 END AS label, d, 1 - greatest(0, least(1, d / second)) AS conf FROM ranked WHERE r = 1),
    judged AS (SELECT *, (d > 1.75 OR conf < 0.04) AS gone FROM best), root AS (SELECT * FROM judged WHERE owner = -1)
    SELECT root.id, CASE WHEN root.gone THEN -1 ELSE root.label END AS root_label, round(root.conf, 9) AS root_confidence, root.gone AS root_rejected,
    CASE WHEN c.gone THEN -1 ELSE coalesce(c.label, -1) END AS child_label, round(coalesce(c.conf, 0), 9) AS child_confidence, coalesce(c.gone, true) AS child_rejected, root.gone OR coalesce(c.gone, true) AS rejected
    FROM root LEFT JOIN judged c ON c.id = root.id AND c.owner = root.label AND NOT root.gone""")
def hier_assign_scores(spark, sf_dir):
    """Thresholds that reject at the root and, of what is left, at the children."""
    rows = embeddings(spark, sf_dir)
    c = seeds(rows, 10)
    tree = HierarchicalSnapshot(ClusterSnapshot(c[:4]), {0: ClusterSnapshot(c[4:7]), 1: ClusterSnapshot(c[7:])})
    out = tree.assign_with_scores(rows, distance_threshold=1.75, confidence_threshold=0.04)
    return out.select("id", "root_label", r9("root_confidence").alias("root_confidence"), "root_rejected", "child_label", r9("child_confidence").alias("child_confidence"), "child_rejected", "rejected")


# --- k-means and relatives ---------------------------------------------------------------------------


def _lloyd_sql(rounds: int, spherical: bool = False) -> str:
    """CTEs c0 .. c<rounds> of centroid tables, and n<t> with the assignment of round t."""
    parts = [E + (f", u AS (SELECT id, {s_unit('x')} AS x FROM e)" if spherical else ", u AS (SELECT id, x FROM e)")]
    parts.append(f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS c FROM u ORDER BY id LIMIT {K})")
    for t in range(rounds):
        d = f"-({s_dot('u.x', 'c.c')})" if spherical else s_sq("u.x", "c.c")
        parts.append(f"n{t} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT u.id, u.x, c.cid, {d} AS d FROM u, c{t} c) GROUP BY id)")
        mean = f"SELECT cid, list(m ORDER BY i) AS c FROM (SELECT cid, i, {'sum' if spherical else 'avg'}(x[i]) AS m FROM n{t}, range(1, 65) t(i) GROUP BY cid, i) GROUP BY cid"
        parts.append(f"c{t + 1} AS MATERIALIZED ({f'SELECT cid, {s_unit(chr(99))} AS c FROM ({mean})' if spherical else mean})")
    return "WITH " + ", ".join(parts)


def _centroid_rows(spark, model) -> DataFrame:
    rows = [(j, *(round(float(c[k]), 6) for k in (0, 31, 63)), round(float((c * c).sum()), 6)) for j, c in enumerate(model.cluster_centers_)]
    return spark.createDataFrame(rows, "label long, c1 double, c32 double, c64 double, norm2 double")


_CENTROID_SQL = f"SELECT cid AS label, round(c[1], 6) AS c1, round(c[32], 6) AS c32, round(c[64], 6) AS c64, round({s_norm2('c')}, 6) AS norm2 FROM c3"


@query(_lloyd_sql(3) + _CENTROID_SQL.replace("SELECT", " SELECT", 1))
def kmeans_lloyd_fixed_init(spark, sf_dir):
    return _centroid_rows(spark, KMeans(K, max_iter=3, tol=0.0, init="first_k", local_bytes=0).fit(embeddings(spark, sf_dir)))


@query(_lloyd_sql(3) + " SELECT round(sum(d), 6) AS inertia, CAST(3 AS BIGINT) AS n_iter FROM n2")
def kmeans_inertia(spark, sf_dir):
    model = KMeans(K, max_iter=3, tol=0.0, init="first_k", local_bytes=0).fit(embeddings(spark, sf_dir))
    return spark.createDataFrame([(round(model.inertia_, 6), model.n_iter_)], "inertia double, n_iter long")


@query(_lloyd_sql(3, spherical=True) + _CENTROID_SQL.replace("SELECT", " SELECT", 1))
def spherical_lloyd_fixed_init(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return _centroid_rows(spark, EmbeddingCluster(K, max_iter=3, tol=0.0, reduction="none", init="first_k", local_bytes=0).fit(rows).model)


def _minibatch_sql(spherical: bool = False) -> str:
    """c3: centroids after the batches id mod 3 = 0, 1, 2; r holds the running resultants on the sphere."""
    x = s_unit("x") if spherical else "x"
    parts = [E + f", u AS MATERIALIZED (SELECT id, {x} AS x FROM e)"]
    parts.append(f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS c, x AS r, {1 if spherical else 0} AS n FROM u ORDER BY id LIMIT {K})")
    for t in range(3):
        d = f"-({s_dot('u.x', 'c.c')})" if spherical else s_sq("u.x", "c.c")
        parts.append(f"a{t} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(cid, (d, cid)) AS cid FROM (SELECT u.id, u.x, c.cid, {d} AS d FROM u, c{t} c WHERE u.id % 3 = {t}) GROUP BY id)")
        parts.append(f"b{t} AS (SELECT cid, list(t ORDER BY i) AS total, max(m) AS m FROM (SELECT cid, i, count(*) AS m, sum(x[i]) AS t FROM a{t}, range(1, 65) t(i) GROUP BY cid, i) GROUP BY cid)")
        blend = "(n * z[1] + m * z[2]) / (n + m)" if spherical else "(n * z[1] + z[2]) / (n + m)"
        new = f"CASE WHEN m IS NULL THEN r ELSE list_transform(list_zip(r, total), lambda z: {blend}) END"
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT cid, {s_unit('r') if spherical else 'r'} AS c, r, n FROM (SELECT cid, {new} AS r, n + coalesce(m, 0) AS n FROM c{t} LEFT JOIN b{t} USING (cid)))")
    return "WITH " + ", ".join(parts) + _CENTROID_SQL.replace("SELECT", " SELECT", 1)


def _batches(rows: DataFrame):
    """The table in three batches by id, each summed up on the executors."""
    frame = feature_frame(rows)
    for part in range(3):
        yield SparkRows(frame.where(F.pmod("id", F.lit(3)) == part), *validate(frame))


class _Fixed:
    def __init__(self, centres):
        self.cluster_centers_ = centres


@query(_minibatch_sql())
def minibatch_step_update(spark, sf_dir):
    """Three running-mean updates that take in the whole table, by id mod 3."""
    rows = embeddings(spark, sf_dir)
    c, counts = seeds(rows), np.zeros(K)
    for batch in _batches(rows):
        found = batch.round([c], "euclidean")[0]
        c, counts = minibatch_step(c, counts, found.n, found.total)
    return _centroid_rows(spark, _Fixed(c))


@query(_minibatch_sql(spherical=True))
def spherical_minibatch_update(spark, sf_dir):
    """The same on the sphere: running resultants blended with batch sums."""
    rows = embeddings(spark, sf_dir).withColumn("features", V.l2_normalize(F.col("features")))
    c = seeds(rows)
    r, counts = c.copy(), np.ones(K)
    for batch in _batches(rows):
        found = batch.round([c], "dot")[0]
        c, r, counts = spherical_minibatch_step(c, r, counts, found.n, found.total)
    return _centroid_rows(spark, _Fixed(c))


@query(f"""WITH {E}, {SPHERE}, w AS (SELECT id, x, cid, exp(20 * (d - max(d) OVER (PARTITION BY id))) AS p FROM p), q AS (SELECT id, x, cid, p / sum(p) OVER (PARTITION BY id) AS p FROM w),
    m AS (SELECT cid, i, sum(p * x[i]) AS t FROM q, range(1, 65) t(i) GROUP BY cid, i), g AS (SELECT cid, sum(p) AS n FROM q GROUP BY cid)
    SELECT cid AS label, round(any_value(n), 6) AS n, round(sqrt(sum(t * t)) / any_value(n), 6) AS resultant_length FROM m JOIN g USING (cid) GROUP BY cid""")
def vmf_em_step(spark, sf_dir):
    """Soft assignment and its sums from fixed directions, equal weights and concentrations of 20."""
    rows = embeddings(spark, sf_dir).withColumn("features", V.l2_normalize(F.col("features")))
    frame = feature_frame(rows)
    n, total, _ = e_step_sums(SparkRows(frame, *validate(frame)), seeds(rows), np.full(K, 20.0), np.full(K, 1 / K))
    out = [(j, round(float(n[j]), 6), round(float(np.linalg.norm(total[j]) / n[j]), 6)) for j in range(K)]
    return spark.createDataFrame(out, "label long, n double, resultant_length double")


@query(f"WITH {E} SELECT round(sum(v), 6) AS total_variance, CAST(0 AS DOUBLE) AS orthonormality_error FROM (SELECT var_samp(x[i]) AS v FROM e, range(1, 65) t(i) GROUP BY i)")
def pca_invariants(spark, sf_dir):
    """All axes together hold the whole variance and are orthonormal."""
    model = EmbeddingReducer(64).fit(embeddings(spark, sf_dir))
    error = float(np.abs(model.components.T @ model.components - np.eye(64)).max())
    return spark.createDataFrame([(round(float(model.explained_variance_.sum()), 6), round(error, 9))], "total_variance double, orthonormality_error double")


@query(f"WITH {E}, g AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY i)) SELECT count(*) AS n, CAST(10 AS BIGINT) AS k, round(sum({s_sq('x', 'g')}), 6) AS total FROM e, g")
def kmeans_fit_decomposition(spark, sf_dir):
    """Within and between sums of squares of fitted clusters add up to the total; no cluster is empty."""
    labelled = KMeans(10, n_init=1, random_state=7).fit(embeddings(spark, sf_dir)).transform(embeddings(spark, sf_dir))
    stats = M.cluster_moments(labelled.select("label", "features")).values()
    n = sum(s[0] for s in stats)
    centre = sum(s[0] * s[1] for s in stats) / n
    total = sum(s[2] + s[0] * float(((s[1] - centre) ** 2).sum()) for s in stats)
    return spark.createDataFrame([(n, len(stats), round(total, 6))], "n long, k long, total double")


@query("SELECT count(*) AS n, CAST(10 AS BIGINT) AS k, CAST(0 AS BIGINT) AS wrong_labels, CAST(0 AS DOUBLE) AS centre_gap, CAST(0 AS DOUBLE) AS cost_gap FROM embeddings")
def kmeans_fit_settled(spark, sf_dir):
    """A settled fit: every row has the label of its nearest returned centre, each centre is the mean of its
    rows, and their squared distances add up to the reported cost.  All of it is measured again by SQL
    expressions over the whole table."""
    rows = embeddings(spark, sf_dir)
    return _settled(rows, KMeans(10, n_init=2, random_state=7, max_iter=200, tol=1e-12, local_bytes=0).fit(rows))


@query("SELECT count(*) AS n, CAST(16 AS BIGINT) AS k, CAST(0 AS BIGINT) AS wrong_labels, CAST(0 AS DOUBLE) AS centre_gap, CAST(0 AS DOUBLE) AS cost_gap FROM embeddings")
def kmeans_bounded_fit_settled(spark, sf_dir):
    """The same of a fit that carries bounds between its rounds and measures only the distances in doubt."""
    rows = embeddings(spark, sf_dir)
    return _settled(rows, KMeans(16, n_init=2, random_state=5, max_iter=200, tol=1e-12, algorithm="hamerly", local_bytes=0).fit(rows))


def _settled(rows, model):
    centres = F.lit([[float(v) for v in c] for c in model.cluster_centers_])
    labelled = model.transform(rows.select("id", "features"))
    away = labelled.withColumn("far", F.transform(centres, lambda c: V.squared_euclidean(F.col("features"), c)))
    own = F.element_at("far", (F.col("label") + 1).cast("int"))
    found = away.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k"), F.sum((own > F.array_min("far") + 1e-9).cast("long")).alias("wrong_labels"), F.sum(own).alias("cost"))
    means = M.cluster_moments(labelled.select("label", "features"))
    gap = max(float(np.abs(m[1] - model.cluster_centers_[j]).max()) for j, m in means.items())
    return found.select("n", "k", "wrong_labels", F.lit(round(gap, 9)).alias("centre_gap"), F.round(F.abs(F.col("cost") - model.inertia_) / model.inertia_, 9).alias("cost_gap"))


@query(f"""WITH {E}, m AS (SELECT i, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY i), v AS (SELECT e.id, m.i, e.x[m.i] - m.m AS v FROM e, m),
    c AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM e) - 1) AS c FROM v a JOIN v b ON a.id = b.id GROUP BY ALL)
    SELECT round(sum(CASE WHEN i = j THEN c END), 6) AS total, round(sum(c * c), 9) AS squares FROM c""")
def pca_spectrum(spark, sf_dir):
    """The variances of all axes add up to the trace of the covariance, and their squares to the sum of its
    squared entries: that holds for its eigenvalues and for no other rotation."""
    model = EmbeddingReducer(64).fit(embeddings(spark, sf_dir))
    v = model.explained_variance_
    return spark.createDataFrame([(round(float(v.sum()), 6), round(float((v * v).sum()), 9))], "total double, squares double")


@query(f"""WITH {E}, m AS (SELECT i, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY i), v AS (SELECT e.id, m.i, e.x[m.i] - m.m AS v FROM e, m),
    c AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM e) - 1) AS c FROM v a JOIN v b ON a.id = b.id GROUP BY ALL)
    SELECT round(sum(CASE WHEN i = j THEN c END), 6) AS total, round(sum(c * c), 9) AS squares FROM c""")
def pca_randomized_spectrum(spark, sf_dir):
    """The same spectrum by the randomized range finder."""
    model = EmbeddingReducer(64, "randomized").fit(embeddings(spark, sf_dir))
    v = model.explained_variance_
    return spark.createDataFrame([(round(float(v.sum()), 6), round(float((v * v).sum()), 9))], "total double, squares double")


VMF_KAPPAS = [5.0 * (j + 1) for j in range(K)]


@query(f"""WITH {E}, {SPHERE}, n AS (SELECT cid, 5.0 * (cid + 1) AS kappa, (cid + 1) / 36.0 AS weight FROM c),
    f AS (SELECT cid, kappa, weight, 31 * ln(kappa) - 32 * ln(2 * pi()) - ln(s) AS norm FROM (SELECT cid, kappa, weight, sum(exp((2 * m + 31) * ln(kappa / 2) - lgamma(m + 1) - lgamma(m + 32))) AS s FROM n, range(0, 90) t(m) GROUP BY cid, kappa, weight)),
    l AS (SELECT p.id, p.x, p.cid, kappa * p.d + ln(weight) + norm AS l FROM p JOIN f ON f.cid = p.cid), w AS (SELECT id, x, cid, l, exp(l - max(l) OVER (PARTITION BY id)) AS p FROM l),
    q AS (SELECT id, x, cid, p / sum(p) OVER (PARTITION BY id) AS p FROM w), m AS (SELECT cid, i, sum(p * x[i]) AS t FROM q, range(1, 65) t(i) GROUP BY cid, i), g AS (SELECT cid, sum(p) AS n FROM q GROUP BY cid)
    SELECT cid AS label, round(any_value(n) / (SELECT count(*) FROM e), 9) AS weight, round(sqrt(sum(t * t)) / any_value(n), 6) AS resultant_length, round(sum(CASE WHEN i = 1 THEN t END) / sqrt(sum(t * t)), 6) AS first FROM m JOIN g USING (cid) GROUP BY cid""")
def vmf_unequal_step(spark, sf_dir):
    """Soft assignment and new weights and directions from unequal weights and concentrations, whose
    normalizers SQL works out from the series of the Bessel function."""
    rows = embeddings(spark, sf_dir).withColumn("features", V.l2_normalize(F.col("features")))
    frame = feature_frame(rows)
    count, d = validate(frame)
    n, total, _ = e_step_sums(SparkRows(frame, count, d), seeds(rows), np.array(VMF_KAPPAS), np.arange(1, K + 1) / 36)
    length = np.linalg.norm(total, axis=1)
    out = [(j, round(float(n[j] / count), 9), round(float(length[j] / n[j]), 6), round(float(total[j, 0] / length[j]), 6)) for j in range(K)]
    return spark.createDataFrame(out, "label long, weight double, resultant_length double, first double")


LINE = """l AS (SELECT row_number() OVER () AS row, l_orderkey * 10 + l_linenumber AS id, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS x, 0 AS truth FROM lineitem),
    c AS (SELECT row_number() OVER (ORDER BY id, x) - 1 AS cid, x AS c FROM l ORDER BY id, x LIMIT 16)"""


def _lines(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100).alias("features"))


@query(f"WITH {LINE}, near AS (SELECT l.row, any_value(l.x) AS x, arg_min(c.cid, ({s_sq('l.x', 'c.c')}, c.cid)) AS cid, min({s_sq('l.x', 'c.c')}) AS d FROM l, c GROUP BY l.row) SELECT cid AS label, count(*) AS n, round(sum(d), 4) AS cost, round(avg(x[1]), 6) AS quantity FROM near GROUP BY cid")
def assign_lineitem_volume(spark, sf_dir):
    """Nearest of 16 centroids for every line item, summed up by cluster."""
    rows = _lines(spark, sf_dir)
    c = matrix_of(rows.orderBy("id", "features").limit(16).select("features").toArrow().column("features").combine_chunks())
    scored = assign_with_scores(rows, c)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 4).alias("cost"), F.round(F.avg(F.element_at("features", 1)), 6).alias("quantity"))


# --- neighbours, density, linkage --------------------------------------------------------------------


def _pairs_sql(radius: float, metric: str = "euclidean") -> str:
    d = f"sqrt({s_sq('a.x', 'b.x')})" if metric == "euclidean" else f"1 - {s_dot('a.x', 'b.x')} / sqrt({s_norm2('a.x')} * {s_norm2('b.x')})"
    return f"near AS MATERIALIZED (SELECT * FROM (SELECT a.id AS src, b.id AS dst, {d} AS distance FROM e a JOIN e b ON a.id < b.id) WHERE distance <= {radius})"


@query(f"WITH {E}, {_pairs_sql(EPS)} SELECT src, dst, round(distance, 9) AS distance FROM near")
def range_self_join(spark, sf_dir):
    frame = feature_frame(embeddings(spark, sf_dir))
    return range_join(frame, *validate(frame), EPS).withColumn("distance", r9("distance"))


PART = "e AS (SELECT p_partkey AS id, [p_size / 50.0, p_retailprice / 100.0]::DOUBLE[] AS x FROM part)"


def _parts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("s"), (F.col("p_retailprice") / 100.0).alias("p"))
    return from_columns(rows, ["s", "p"], "p_partkey").select("id", "features")


@query(f"WITH {PART}, {_pairs_sql(0.0205)} SELECT src, dst, round(distance, 9) AS distance FROM near")
def range_join_grid(spark, sf_dir):
    frame = feature_frame(_parts(spark, sf_dir))
    return range_join(frame, *validate(frame), 0.0205).withColumn("distance", r9("distance"))


KNN = f"""k AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM (SELECT a.id AS src, b.id AS dst, sqrt({s_sq('a.x', 'b.x')}) AS d FROM e a JOIN e b ON a.id <> b.id))"""


@query(f"WITH {E}, {KNN} SELECT src, CAST(r AS INTEGER) AS rank, dst, round(d, 9) AS distance FROM k WHERE r <= 3")
def knn_self_join(spark, sf_dir):
    frame = feature_frame(embeddings(spark, sf_dir))
    n, _ = validate(frame)
    return knn_join(frame, n, 3).withColumn("distance", r9("distance"))


@query(f"WITH {E}, {KNN} SELECT src AS id, round(d, 9) AS core FROM k WHERE r = 5")
def core_distance(spark, sf_dir):
    frame = feature_frame(embeddings(spark, sf_dir))
    return core_distances(frame, validate(frame)[0], 5).select("id", r9("core").alias("core"))


@query(f"WITH {E}, {KNN}, core AS (SELECT src AS id, d AS core FROM k WHERE r = 5), {_pairs_sql(EPS)} SELECT n.src, n.dst, round(greatest(a.core, b.core, n.distance), 9) AS weight FROM near n JOIN core a ON a.id = n.src JOIN core b ON b.id = n.dst")
def mutual_reachability(spark, sf_dir):
    frame = feature_frame(embeddings(spark, sf_dir))
    n, d = validate(frame)
    core = materialize(core_distances(frame, n, 5), "core")
    near = range_join(frame.join(core, "id"), n, d, EPS, given=("core",))
    return near.select("src", "dst", r9(F.greatest("a_core", "b_core", "distance")).alias("weight"))


def _dbscan_sql(radius: float, least: int, metric: str = "euclidean", source: str = E) -> str:
    return f"""WITH RECURSIVE {source}, {_pairs_sql(radius, metric)}, both_ways AS (SELECT src, dst FROM near UNION ALL SELECT dst, src FROM near),
    core AS MATERIALIZED (SELECT id FROM e LEFT JOIN both_ways ON src = id GROUP BY id HAVING count(dst) + 1 >= {least}),
    cc AS MATERIALIZED (SELECT src, dst FROM both_ways WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT cc.dst, reach.root FROM reach JOIN cc ON cc.src = reach.id AND reach.root < cc.dst),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM comp)),
    inside AS (SELECT id, label FROM comp JOIN num USING (root)), border AS (SELECT src AS id, min(label) AS label FROM both_ways JOIN inside ON inside.id = dst GROUP BY src)"""


_LABELS = " SELECT e.id, coalesce(inside.label, border.label, -1) AS label FROM e LEFT JOIN inside USING (id) LEFT JOIN border USING (id)"


@query(_dbscan_sql(1.1, 3) + _LABELS)
def dbscan_euclidean(spark, sf_dir):
    return DBSCAN(1.1, 3).fit(embeddings(spark, sf_dir)).labels_


@query(_dbscan_sql(0.62, 4, "cosine") + _LABELS)
def dbscan_cosine(spark, sf_dir):
    return DBSCAN(0.62, 4, "cosine").fit(embeddings(spark, sf_dir)).labels_


@query(_dbscan_sql(1.1, 3) + " SELECT id FROM core")
def dbscan_core_points(spark, sf_dir):
    return DBSCAN(1.1, 3).fit(embeddings(spark, sf_dir)).core_sample_indices_


@query(_dbscan_sql(0.0205, 2, source=PART) + " SELECT id, label FROM (" + _LABELS + ")")
def dbscan_low_dimensions(spark, sf_dir):
    return DBSCAN(0.0205, 2).fit(_parts(spark, sf_dir)).labels_


@query(f"""WITH RECURSIVE {E}, {_pairs_sql(1.05)}, both_ways AS (SELECT src, dst FROM near UNION ALL SELECT dst, src FROM near),
    reach(id, root) AS (SELECT id, id FROM e UNION SELECT b.dst, reach.root FROM reach JOIN both_ways b ON b.src = reach.id AND reach.root < b.dst)
    SELECT id, min(root) AS component FROM reach GROUP BY id""")
def single_linkage_cut(spark, sf_dir):
    """Single-linkage clusters below a height: components of the pairs within it."""
    frame = feature_frame(embeddings(spark, sf_dir))
    return components_within(frame, *validate(frame), 1.05)


# --- quality -----------------------------------------------------------------------------------------


def _truth(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).withColumnRenamed("truth", "label")


def _silhouette_sql(d: str) -> str:
    return f"""WITH {E}, p AS (SELECT a.id, a.truth AS la, b.truth AS lb, avg(CASE WHEN a.id <> b.id THEN {d} END) AS m FROM e a, e b GROUP BY ALL),
    s AS (SELECT id, coalesce(max(m) FILTER (la = lb), 0) AS a, min(m) FILTER (la <> lb) AS b FROM p GROUP BY id)"""


@query(_silhouette_sql(f"sqrt({s_sq('a.x', 'b.x')})") + " SELECT id, round(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s")
def silhouette(spark, sf_dir):
    return M.silhouette_samples(_truth(spark, sf_dir)).select("id", F.round("silhouette", 6).alias("silhouette"))


@query(_silhouette_sql(f"1 - {s_dot('a.x', 'b.x')}") + " SELECT round(avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM s")
def cosine_silhouette(spark, sf_dir):
    return M.cosine_silhouette_samples(_truth(spark, sf_dir)).agg(F.round(F.avg("silhouette"), 6).alias("score"))


MOMENTS = f"{E}, m AS (SELECT truth, i, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY truth, i), c AS (SELECT truth, list(m ORDER BY i) AS c FROM m GROUP BY truth), n AS (SELECT truth, count(*) AS n FROM e GROUP BY truth)"


@query(f"""WITH {MOMENTS}, g AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY i)),
    b AS (SELECT sum(n * {s_sq('c', 'g')}) AS between, count(*) AS k FROM c JOIN n USING (truth), g), w AS (SELECT sum({s_sq('x', 'c')}) AS within, count(*) AS n FROM e JOIN c USING (truth))
    SELECT round((between / (k - 1)) / (within / (n - k)), 6) AS score FROM b, w""")
def calinski_harabasz(spark, sf_dir):
    return spark.createDataFrame([(round(M.calinski_harabasz_score(_truth(spark, sf_dir)), 6),)], "score double")


@query(f"""WITH {MOMENTS}, s AS (SELECT truth, any_value(c) AS c, avg(sqrt({s_sq('x', 'c')})) AS s FROM e JOIN c USING (truth) GROUP BY truth)
    SELECT round(avg(r), 6) AS score FROM (SELECT a.truth, max((a.s + b.s) / sqrt({s_sq('a.c', 'b.c')})) AS r FROM s a JOIN s b ON a.truth <> b.truth GROUP BY a.truth)""")
def davies_bouldin(spark, sf_dir):
    return spark.createDataFrame([(round(M.davies_bouldin_score(_truth(spark, sf_dir)), 6),)], "score double")


def _labelled(spark, sf_dir) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return assign(rows, seeds(rows))


TABLE = f"WITH {E}, {FIRST}, {s_scored()}, t AS (SELECT cid, truth, count(*) AS n FROM s GROUP BY ALL)"


@query(TABLE + " SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT cid, max(n) AS m, sum(n) AS n FROM t GROUP BY cid)")
def purity(spark, sf_dir):
    return M.purity(_labelled(spark, sf_dir)).select(F.round("purity", 6).alias("purity"))


@query(TABLE + """, w AS (SELECT sum(n) AS w FROM t), a AS (SELECT cid, sum(n) AS a FROM t GROUP BY cid), b AS (SELECT truth, sum(n) AS b FROM t GROUP BY truth)
    SELECT round(2 * mi / (ha + hb + 1e-30), 6) AS nmi FROM (SELECT sum(n / w * ln(n * w / (a * b))) AS mi FROM t JOIN a USING (cid) JOIN b USING (truth), w),
    (SELECT -sum(a / w * ln(a / w)) AS ha FROM a, w), (SELECT -sum(b / w * ln(b / w)) AS hb FROM b, w)""")
def nmi(spark, sf_dir):
    return M.nmi(_labelled(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))


@query(TABLE + """, j AS (SELECT sum(n * (n - 1) / 2.0) AS j, sum(n) AS w FROM t), a AS (SELECT sum(a * (a - 1) / 2.0) AS a FROM (SELECT sum(n) AS a FROM t GROUP BY cid)),
    b AS (SELECT sum(b * (b - 1) / 2.0) AS b FROM (SELECT sum(n) AS b FROM t GROUP BY truth))
    SELECT round((j - a * b / (w * (w - 1) / 2.0)) / ((a + b) / 2 - a * b / (w * (w - 1) / 2.0)), 6) AS ari FROM j, a, b""")
def ari(spark, sf_dir):
    return M.ari(_labelled(spark, sf_dir)).select(F.round("ari", 6).alias("ari"))


@query(TABLE + """ SELECT cid AS label, CAST(sum(n) AS BIGINT) AS size, arg_min(truth, (-n, truth)) AS dominant, round(max(n) / sum(n), 6) AS purity FROM t GROUP BY cid ORDER BY size DESC, label LIMIT 5""")
def top_clusters(spark, sf_dir):
    return M.top_clusters(_labelled(spark, sf_dir), 5).withColumn("purity", F.round("purity", 6))


INTRA = f"WITH {E}, {FIRST}, {s_scored()}, i AS (SELECT s.id, s.cid, {s_dot('s.x', 'c.c')} AS sim FROM s JOIN c USING (cid))"


@query(INTRA + " SELECT cid AS label, arg_min(id, (-sim, id)) AS id, round(max(sim), 9) AS similarity FROM i GROUP BY cid")
def representatives(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return M.representatives(rows, seeds(embeddings(spark, sf_dir))).select("label", "id", r9("similarity").alias("similarity"))


@query(INTRA + " SELECT cid AS label, round(avg(sim), 6) AS intra_similarity FROM i GROUP BY cid")
def intra_similarity(spark, sf_dir):
    return M.intra_similarity(_labelled(spark, sf_dir), seeds(embeddings(spark, sf_dir))).withColumn("intra_similarity", F.round("intra_similarity", 6))


@query(f"WITH {E} SELECT truth AS label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS resultant_length FROM (SELECT truth, i, count(*) AS n, avg(x[i]) AS m FROM e, range(1, 65) t(i) GROUP BY truth, i) GROUP BY truth")
def resultant_length(spark, sf_dir):
    rows = embeddings(spark, sf_dir).withColumnRenamed("truth", "label")
    return M.resultant_lengths(rows).select(F.col("label").cast("int").alias("label"), "n", F.round("resultant_length", 6).alias("resultant_length"))


# --- streaming ---------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT ts, value, least(abs(value - 10), abs(value - 50), abs(value - 200)) AS g FROM events),
    l AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, CASE WHEN abs(value - 10) = g THEN 0 WHEN abs(value - 50) = g THEN 1 ELSE 2 END AS label, g * g AS d FROM s)
    SELECT CAST(label AS BIGINT) AS label, epoch_us(w) // 1000000 AS window_start, count(*) AS n, round(avg(d), 6) AS mean_distance, round((avg(d) - 100) / 100, 6) AS relative_drift FROM l GROUP BY label, w""")
def stream_windowed_drift(spark, sf_dir):
    """Events scored as a stream and summed up by day, in one available-now run."""
    from vecloom.streaming.scoring import windowed_drift

    events = table(spark, sf_dir, "events")
    instant = F.col("ts") if events.schema["ts"].dataType.typeName() == "timestamp" else F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit(" UTC")))
    source = materialize(events.select(instant.alias("ts"), "value"), "events-source")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0]).withColumn("features", F.array("value")).drop("value")
    snapshot = ClusterSnapshot([[10.0], [50.0], [200.0]], fit_mean=[100.0] * 3)
    out = f"{checkpoint_root(spark)}/vecloom/stream-{uuid.uuid4().hex}"
    drift = windowed_drift(stream, snapshot, "ts", "1 day")
    run = drift.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(out)
    last = last.where(F.col("batch") == last.agg(F.max("batch")).first()[0])
    return last.select("label", F.unix_timestamp("window_start").alias("window_start"), "n", F.round("mean_distance", 6).alias("mean_distance"), F.round("relative_drift", 6).alias("relative_drift"))


@query("""WITH s AS (SELECT ts, value AS a, event_id % 97 + 1.0 AS b FROM events), u AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b FROM s),
    c(label, ca, cb, kappa) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 5.0::DOUBLE), (1, 0.6::DOUBLE, 0.8::DOUBLE, 10.0::DOUBLE), (2, 0.0::DOUBLE, 1.0::DOUBLE, 20.0::DOUBLE)),
    l AS (SELECT w, a, b, arg_max(label, (a * ca + b * cb, -label)) AS label, max(a * ca + b * cb) AS sim FROM u, c GROUP BY w, a, b, u.rowid),
    g AS (SELECT w, label, count(*) AS n, avg(sim) AS m, sum(a) AS sa, sum(b) AS sb FROM l GROUP BY ALL), r AS (SELECT *, sqrt(sa * sa + sb * sb) AS len, sqrt(sa * sa + sb * sb) / n AS r FROM g)
    SELECT CAST(r.label AS BIGINT) AS label, epoch_us(w) // 1000000 AS window_start, n, round(m, 6) AS mean_distance, round((m - 0.9) / 0.9, 6) AS relative_drift,
      round((r * (2 - r * r) / greatest(1 - r * r, 1e-10) - kappa) / kappa, 4) AS kappa_drift, round(1 - (sa * ca + sb * cb) / len, 6) AS direction_drift FROM r JOIN c ON c.label = r.label""".replace("u AS (SELECT time", "u AS (SELECT row_number() OVER () AS rowid, time"))
def stream_direction_drift(spark, sf_dir):
    """Directions of two columns of a stream: how concentrated each cluster's are by day, and how far they turned."""
    from vecloom.streaming.scoring import windowed_drift

    events = table(spark, sf_dir, "events")
    instant = F.col("ts") if events.schema["ts"].dataType.typeName() == "timestamp" else F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit(" UTC")))
    source = materialize(events.select(instant.alias("ts"), F.array("value", F.col("event_id") % 97 + 1.0).alias("features")), "events-source")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    snapshot = ClusterSnapshot([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]], spherical=True, fit_mean=[0.9] * 3)
    snapshot.confidence_percentiles, snapshot.kappas = np.zeros((3, 4)), np.array([5.0, 10.0, 20.0])
    out = f"{checkpoint_root(spark)}/vecloom/stream-{uuid.uuid4().hex}"
    drift = windowed_drift(stream, snapshot, "ts", "1 day")
    run = drift.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(out)
    last = last.where(F.col("batch") == last.agg(F.max("batch")).first()[0])
    figures = [F.round(c, 4 if c == "kappa_drift" else 6).alias(c) for c in ("mean_distance", "relative_drift", "kappa_drift", "direction_drift")]
    return last.select("label", F.unix_timestamp("window_start").alias("window_start"), "n", *figures)


# --- fits without a SQL form (checked by invariants in tests) ----------------------------------------


@query()
def pca_reduce(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return EmbeddingReducer(8).fit_transform(rows).select("id", "reduced")


@query()
def kmeans_fit(spark, sf_dir):
    return KMeans(10, n_init=3, random_state=7, local_bytes=0).fit(embeddings(spark, sf_dir)).labels_


@query()
def kmeans_cosine_fit(spark, sf_dir):
    return KMeans(10, n_init=3, random_state=7, metric="cosine", local_bytes=0).fit(embeddings(spark, sf_dir)).labels_


@query()
def kmeans_lineitem_fit(spark, sf_dir):
    """k-means over every line item."""
    return _centroids(spark, KMeans(16, n_init=1, max_iter=10, random_state=1).fit(_lines(spark, sf_dir)))


def _centroids(spark, model) -> DataFrame:
    return spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(model.cluster_centers_)], "label long, centre array<double>")


@query()
def minibatch_fit(spark, sf_dir):
    return MiniBatchKMeans(10, batch_size=256, max_iter=20, random_state=3, local_bytes=0).fit(embeddings(spark, sf_dir)).labels_


@query()
def embedding_cluster_fit(spark, sf_dir):
    return EmbeddingCluster(10, reduction_dim=16, n_init=2, random_state=1, local_bytes=0).fit(embeddings(spark, sf_dir)).labels_


@query()
def embedding_minibatch_fit(spark, sf_dir):
    return EmbeddingCluster(10, reduction_dim=16, n_init=1, max_iter=20, batch_size=256, algorithm="minibatch", local_bytes=0).fit(embeddings(spark, sf_dir)).labels_


@query()
def vmf_refine(spark, sf_dir):
    model = EmbeddingCluster(6, reduction_dim=16, n_init=1, reduction="matryoshka", local_bytes=0).fit(embeddings(spark, sf_dir)).refine_vmf(max_iter=10)
    return model.soft_assign()


@query()
def hdbscan_fit(spark, sf_dir):
    model = HDBSCAN(5, local_rows=1).fit(_supplier(spark, sf_dir))
    return model.labels_.join(model.probabilities_, "id")


def _supplier(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("b"), F.col("s_nationkey").cast("double").alias("n"))
    return from_columns(rows, ["b", "n"], "s_suppkey").select("id", "features")


@query()
def agglomerative_fit(spark, sf_dir):
    return AgglomerativeClustering(5, "ward").fit(_supplier(spark, sf_dir)).labels_


WARD_SQL = """WITH s AS (SELECT s_suppkey AS id, [s_acctbal / 1000, CAST(s_nationkey AS DOUBLE)] AS x FROM supplier), g AS (SELECT [avg(x[1]), avg(x[2])] AS g FROM s)
    SELECT (SELECT count(*) - 1 FROM s) AS merges, round((SELECT sum((x[1] - g[1]) * (x[1] - g[1]) + (x[2] - g[2]) * (x[2] - g[2])) FROM s, g), 6) AS total,
    round((SELECT min(sqrt((a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2]))) FROM s a JOIN s b ON a.id < b.id), 9) AS lowest"""


def _ward_invariants(spark, sf_dir, **limits) -> DataFrame:
    h = AgglomerativeClustering(1, "ward", **limits).fit(_supplier(spark, sf_dir)).heights(spark)
    total, lowest = F.sum(F.col("distance") * F.col("distance") / 2), F.min("distance")
    return h.agg(F.count(F.lit(1)).alias("merges"), F.round(total, 6).alias("total"), F.round(lowest, 9).alias("lowest"))


@query(WARD_SQL)
def ward_heights(spark, sf_dir):
    """Half the squared heights of all merges add up to the total sum of squares; the lowest is the nearest pair."""
    return _ward_invariants(spark, sf_dir)


@query(WARD_SQL)
def ward_rounds_heights(spark, sf_dir):
    """The same of merges made in distributed rounds, down to a matrix of at most 50 clusters."""
    return _ward_invariants(spark, sf_dir, max_rows=50)


TREE_CUT = 1.2


@query(f"""WITH RECURSIVE {E}, {KNN}, core AS (SELECT src AS id, d AS core FROM k WHERE r = 5), {_pairs_sql(TREE_CUT)},
    linked AS MATERIALIZED (SELECT src, dst FROM near JOIN core a ON a.id = src JOIN core b ON b.id = dst WHERE greatest(a.core, b.core) <= {TREE_CUT}), both_ways AS (SELECT src, dst FROM linked UNION ALL SELECT dst, src FROM linked),
    reach(id, root) AS (SELECT id, id FROM e UNION SELECT b.dst, reach.root FROM reach JOIN both_ways b ON b.src = reach.id AND reach.root < b.dst)
    SELECT (SELECT count(*) - 1 FROM e) AS edges, (SELECT count(*) FROM e) - count(DISTINCT root) AS light FROM (SELECT id, min(root) AS root FROM reach GROUP BY id)""")
def reachability_tree_cut(spark, sf_dir):
    """A spanning tree of mutual reachability has as many edges below a height as rows less components there."""
    frame = materialize(feature_frame(embeddings(spark, sf_dir)), "features")
    n, _ = validate(frame)
    tree = reachability_tree(frame.join(core_distances(frame, n, 5), "id"), n)
    return tree.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum((F.col("weight") <= TREE_CUT).cast("long")), F.lit(0)).alias("light"))


@query(f"""WITH RECURSIVE {E}, {KNN}, core AS (SELECT src AS id, d AS core FROM k WHERE r = 5), {_pairs_sql(TREE_CUT)},
    linked AS MATERIALIZED (SELECT src, dst FROM near JOIN core a ON a.id = src JOIN core b ON b.id = dst WHERE greatest(a.core, b.core) <= {TREE_CUT}), both_ways AS (SELECT src, dst FROM linked UNION ALL SELECT dst, src FROM linked),
    reach(id, root) AS (SELECT id, id FROM e UNION SELECT b.dst, reach.root FROM reach JOIN both_ways b ON b.src = reach.id AND reach.root < b.dst),
    sizes AS (SELECT root, count(*) AS n FROM (SELECT id, min(root) AS root FROM reach GROUP BY id) GROUP BY root)
    SELECT coalesce(sum(n), 0)::BIGINT AS "rows", count(*) AS components FROM sizes WHERE n >= 4""")
def hdbscan_entries_cut(spark, sf_dir):
    """Rows that have entered a component of at least four rows below a height, and how many such components
    there are, from the contracted spanning tree: entries counted, births less merges."""
    frame = materialize(feature_frame(embeddings(spark, sf_dir)), "features")
    n, _ = validate(frame)
    tree = reachability_tree(frame.join(core_distances(frame, n, 5), "id"), n)
    found = contract(frame.select("id"), tree, 4, local_edges=100)
    low = F.col("weight") <= TREE_CUT
    entered = found.rows.where(low).agg(F.count(F.lit(1)).alias("rows"))
    born = found.births.join(found.rows.where(low).select("rank").distinct(), "rank", "left_semi").agg(F.count(F.lit(1)).alias("born"))
    merged = found.merges.where(low).agg(F.count(F.lit(1)).alias("merged"))
    return entered.join(F.broadcast(born)).join(F.broadcast(merged)).select("rows", (F.col("born") - F.col("merged")).alias("components"))


@query(f"""WITH {E}, {FIRST}, {s_scored()}, q AS (SELECT cid, quantile_cont(conf, 0.1) AS p FROM s GROUP BY cid)
    SELECT id, CASE WHEN conf < p THEN -1 ELSE cid END AS label, round(d, 9) AS distance, round(conf, 9) AS confidence, conf < p AS rejected FROM s JOIN q USING (cid)""")
def snapshot_roundtrip(spark, sf_dir):
    """A calibrated snapshot, saved and loaded again, scores with its adaptive threshold."""
    rows = embeddings(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/vecloom/snapshot-{uuid.uuid4().hex}"
    ClusterSnapshot(seeds(rows)).calibrate(rows).save(spark, path)
    out = ClusterSnapshot.load(spark, path).assign_with_scores(rows, adaptive_threshold=True)
    return out.select("id", "label", r9("distance").alias("distance"), r9("confidence").alias("confidence"), "rejected")


@query(ORACLE_SQL["assign_top2_scores"])
def assign_table_function(spark, sf_dir):
    """The flagship scores through SQL: a saved snapshot as a table function over the whole table."""
    from vecloom.operators.table_function import register

    rows = embeddings(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/vecloom/function-{uuid.uuid4().hex}"
    ClusterSnapshot(seeds(rows)).save(spark, path)
    register(spark, "vecloom_assign", path)
    rows.createOrReplaceTempView("vecloom_assign_rows")
    out = spark.sql("SELECT * FROM vecloom_assign(TABLE(vecloom_assign_rows), confidence_threshold => 0.02)")
    return out.select("id", "label", *[r9(c).alias(c) for c in ("distance", "second_distance", "confidence")], "rejected")


@query()
def hier_build(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return HierarchicalSnapshot.build(rows, KMeans(3, n_init=1).fit(rows), 3).assign(rows).select("id", "root_label", "child_label")


@query("SELECT count(*) AS n, CAST(3 AS BIGINT) AS children, CAST(0 AS BIGINT) AS wrong_labels, CAST(0 AS BIGINT) AS far_centres, CAST(0 AS BIGINT) AS size_gap FROM embeddings")
def hier_children_settled(spark, sf_dir):
    """Children fitted together: every row has the child whose centre is nearest among those of its root cluster,
    each centre is the direction of its rows' sum, and the stored sizes are theirs.  Measured again by SQL
    expressions over the whole table."""
    rows = embeddings(spark, sf_dir).select("id", "features")
    tree = HierarchicalSnapshot.build(rows, KMeans(3, n_init=1).fit(rows), 3, n_init=2)
    centres = F.lit([[[float(v) for v in c] for c in tree.children[j].centroids] for j in sorted(tree.children)])
    place = F.element_at(F.create_map(*[F.lit(v) for i, j in enumerate(sorted(tree.children)) for v in (j, i + 1)]), F.col("root_label").cast("int"))
    unit = tree.assign(rows).withColumn("features", V.l2_normalize(F.col("features")))
    judged = unit.withColumn("near", F.transform(F.element_at(centres, place), lambda c: V.dot(F.col("features"), c)))
    own = F.element_at("near", (F.col("child_label") + 1).cast("int"))
    found = judged.agg(F.count(F.lit(1)).alias("n"), F.sum((own < F.array_max("near") - 1e-9).cast("long")).alias("wrong_labels"))
    moments = M.cluster_moments(unit.select((F.col("root_label") * 1000 + F.col("child_label")).alias("label"), "features"))
    far = gap = 0
    for j, child in tree.children.items():
        for i, centre in enumerate(child.centroids):
            size, mean = moments[1000 * j + i][:2] if 1000 * j + i in moments else (0, centre)
            far += int(1 - float(np.dot(mean, centre)) / float(np.linalg.norm(mean)) > 1e-4)
            gap += abs(int(size) - child.sizes[i])
    return found.select("n", F.lit(len(tree.children)).cast("long").alias("children"), "wrong_labels", F.lit(far).cast("long").alias("far_centres"), F.lit(gap).cast("long").alias("size_gap"))


@query("""SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 9) AS first,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 9) AS norm2 FROM embeddings""")
def array_files_roundtrip(spark, sf_dir):
    """All vectors written as NumPy files, a pair a partition, and read back in ranges of rows."""
    path = f"{checkpoint_root(spark)}/vecloom/{spark.sparkContext.applicationId}/arrays-{uuid.uuid4().hex}"
    write_arrays(embeddings(spark, sf_dir), path)
    back = read_arrays(spark, path)
    return back.select("id", F.size("features").cast("long").alias("dims"), r9(F.element_at("features", 1)).alias("first"), r9(V.norm2(F.col("features"))).alias("norm2"))
