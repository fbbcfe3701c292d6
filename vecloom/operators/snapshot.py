"""Cluster snapshots: frozen centroids that score new rows, reject, calibrate and report drift.

Scoring is a narrow, stateless Arrow map, so it runs alike on batch and streaming frames.  Calibration
and drift are grouped aggregates whose results have one row a cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import parse_metric
from vecloom.operators.assign import normalized, scores
from vecloom.operators.kmeans import load_vectors, save_vectors
from vecloom.plans.durable import materialized
from vecloom.plans.frames import map_matrix

PERCENTILES = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50}


@dataclass
class DriftReport:
    """``clusters``: label, new_size, new_mean_distance, relative_drift, kappa_drift, direction_drift;
    ``overall``: global_mean_distance, rejection_rate, n_samples."""

    clusters: DataFrame
    overall: DataFrame


class ClusterSnapshot:
    def __init__(self, centroids, metric: str = "euclidean", spherical: bool = False, reducer=None, normalize: bool = False, algorithm: str = "kmeans", features: str = "features", sizes=None, fit_mean=None, n_fitted: int | None = None):
        self.centroids = np.asarray(centroids, dtype=np.float64)
        self.metric = "cosine" if spherical else parse_metric(metric)
        self.spherical, self.reducer, self.normalize, self.algorithm, self.features = spherical, reducer, normalize or spherical, algorithm, features
        self.sizes = list(sizes or [0] * self.k)
        self.n_fitted = int(sum(self.sizes)) if n_fitted is None else n_fitted
        self.fit_mean = np.zeros(self.k) if fit_mean is None else np.asarray(fit_mean, dtype=np.float64)
        self.confidence_percentiles: np.ndarray | None = None  # k x 4: p5 p10 p25 p50
        self.variances: np.ndarray | None = None
        self.kappas: np.ndarray | None = None
        self.resultants: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.centroids)

    @property
    def d(self) -> int:
        return self.centroids.shape[1]

    @property
    def input_dim(self) -> int:
        return self.reducer.input_dim if self.reducer is not None else self.d

    @property
    def is_calibrated(self) -> bool:
        return self.confidence_percentiles is not None

    def prepare(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.input_dim:
            raise ValueError(f"vectors have {x.shape[1]} dimensions, the snapshot {self.input_dim}")
        if self.normalize:
            x = normalized(x)
        return self.reducer.project(x) if self.reducer is not None else x

    def _scores(self, x: np.ndarray, mode: str):
        x = self.prepare(x)
        out = scores(x, self.centroids, "dot" if self.spherical else self.metric, self.variances if mode == "mahalanobis" else None)
        return x, out

    def judged(self, x: np.ndarray, distance_threshold: float | None = None, confidence_threshold: float | None = None, adaptive_threshold: bool = False, adaptive_percentile: str = "p10", boundary_mode: str = "voronoi"):
        """label (-1 where rejected), distance, second distance, confidence and rejected of a matrix.

        The global thresholds come first; the adaptive one looks at what they left.
        """
        _, (label, distance, second, confidence) = self._scores(x, boundary_mode)
        rejected = np.zeros(len(label), bool)
        if distance_threshold is not None:
            rejected |= distance < distance_threshold if self.spherical and boundary_mode == "voronoi" else distance > distance_threshold
        if confidence_threshold is not None:
            rejected |= confidence < confidence_threshold
        if adaptive_threshold:
            rejected |= confidence < self.confidence_percentiles[label, list(PERCENTILES).index(adaptive_percentile)]
        return np.where(rejected, -1, label), distance, second, confidence, rejected

    def check_thresholds(self, adaptive_threshold: bool = False, adaptive_percentile: str = "p10", boundary_mode: str = "voronoi", **_) -> None:
        """ValueError for what this snapshot cannot judge by."""
        if boundary_mode not in ("voronoi", "mahalanobis"):
            raise ValueError("boundary_mode is voronoi or mahalanobis")
        if boundary_mode == "mahalanobis" and self.variances is None:
            raise ValueError("mahalanobis boundaries need a calibrated snapshot")
        if adaptive_percentile not in PERCENTILES:
            raise ValueError(f"adaptive_percentile is one of {list(PERCENTILES)}")
        if adaptive_threshold and not self.is_calibrated:
            raise ValueError("adaptive thresholds need a calibrated snapshot")

    def _scored(self, df: DataFrame, boundary_mode: str = "voronoi", vectors: str | None = None) -> DataFrame:
        self.check_thresholds(boundary_mode=boundary_mode)
        shared = df.sparkSession.sparkContext.broadcast(self)
        added = [("label", T.LongType(), pa.int64()), *[(n, T.DoubleType(), pa.float64()) for n in ("distance", "second_distance", "confidence")]]
        if vectors:
            added.append((vectors, T.ArrayType(T.DoubleType()), pa.list_(pa.float64())))

        def compute(x):
            from vecloom.plans.frames import list_array

            seen, out = shared.value._scores(x, boundary_mode)
            return [*out, *([list_array(seen)] if vectors else [])]

        return map_matrix(df, self.features, added, compute)

    def assign(self, df: DataFrame, boundary_mode: str = "voronoi") -> DataFrame:
        return self._scored(df, boundary_mode).drop("distance", "second_distance", "confidence")

    def assign_with_scores(self, df: DataFrame, distance_threshold: float | None = None, confidence_threshold: float | None = None, adaptive_threshold: bool = False, adaptive_percentile: str = "p10", boundary_mode: str = "voronoi") -> DataFrame:
        """label (-1 where rejected), distance, second_distance, confidence, rejected (see ``judged``)."""
        given = dict(distance_threshold=distance_threshold, confidence_threshold=confidence_threshold, adaptive_threshold=adaptive_threshold, adaptive_percentile=adaptive_percentile, boundary_mode=boundary_mode)
        self.check_thresholds(**given)
        shared = df.sparkSession.sparkContext.broadcast(self)
        added = [("label", T.LongType(), pa.int64()), *[(n, T.DoubleType(), pa.float64()) for n in ("distance", "second_distance", "confidence")], ("rejected", T.BooleanType(), pa.bool_())]
        out = map_matrix(df, self.features, added, lambda x: list(shared.value.judged(x, **given)))
        return out.withColumn("rejected", F.coalesce("rejected", F.lit(False)))

    def calibrate(self, df: DataFrame) -> ClusterSnapshot:
        """Learn confidence percentiles (exact), per-dimension variances and, if spherical, concentrations."""
        rows = self._scored(df, vectors="__seen").select("label", "confidence", F.col("__seen").alias("x")).where("label is not null")
        stats = cluster_statistics(rows, self.k, self.d)
        self.confidence_percentiles = np.zeros((self.k, 4))
        for label, values in unit_percentiles(rows.select("label", "confidence"), list(PERCENTILES.values())).items():
            self.confidence_percentiles[label] = values
        self.variances = np.full((self.k, self.d), 1e-12)
        self.kappas, self.resultants = (np.zeros(self.k), np.zeros(self.k)) if self.spherical else (None, None)
        for label, (n, mean, m2) in stats.items():
            if n > 1:
                self.variances[label] = np.maximum(m2 / (n - 1), 1e-12)
            if self.spherical:
                r = float(np.linalg.norm(mean))
                self.kappas[label] = r * (self.d - r * r) / max(1 - r * r, 1e-10)
                self.resultants[label] = r
        return self

    def drift_report(self, df: DataFrame, compat: bool = True) -> DriftReport:
        """How far new rows sit from what was fitted; calibrated spherical snapshots also report how
        concentrations and directions (against the centroids) moved.

        The rejection rate is the share of rows beyond twice the mean over clusters of the fitted means
        (for similarities: below it); 0 where that mean is 0 or nothing was fitted.  ``compat=False``
        takes half of it for similarities, so that only rows far from everything count."""
        spark = df.sparkSession
        rows = self._scored(df, vectors="__seen").where("label is not null")
        seen = {r["label"]: (r["n"], r["m"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("m")).collect()}
        moved = cluster_statistics(rows.select("label", F.col("__seen").alias("x")), self.k, self.d) if self.spherical and self.is_calibrated else None
        table = []
        for j in range(self.k):
            n, mean = seen.get(j, (0, 0.0))
            fit = float(self.fit_mean[j])
            relative = (mean - fit) / abs(fit) if abs(fit) > 1e-30 else (0.0 if abs(mean) <= 1e-30 else float("nan"))
            kappa = direction = None
            if moved is not None:
                kappa = direction = 0.0
                if j in moved:
                    m = moved[j][1]
                    r = float(np.linalg.norm(m))
                    now = r * (self.d - r * r) / max(1 - r * r, 1e-10)
                    kappa = (now - self.kappas[j]) / abs(self.kappas[j]) if abs(self.kappas[j]) > 1e-10 else 0.0
                    direction = 1 - min(1.0, max(-1.0, float(m @ self.centroids[j]) / r)) if r > 1e-30 else 1.0
            table.append((j, n, float(mean), float(relative), None if kappa is None else float(kappa), None if direction is None else float(direction)))
        schema = "label long, new_size long, new_mean_distance double, relative_drift double, kappa_drift double, direction_drift double"
        usual = float(self.fit_mean.mean()) if self.n_fitted > 0 else 0.0
        if abs(usual) <= 1e-30:
            beyond = F.lit(False)
        elif self.spherical:
            beyond = F.col("distance") < F.lit(2 * usual if compat else usual / 2)
        else:
            beyond = F.col("distance") > F.lit(2 * usual)
        overall = rows.agg(
            F.coalesce(F.avg("distance"), F.lit(0.0)).alias("global_mean_distance"),
            F.coalesce(F.avg(beyond.cast("double")), F.lit(0.0)).alias("rejection_rate"),
            F.count(F.lit(1)).alias("n_samples"),
        )
        return DriftReport(spark.createDataFrame(table, schema), overall)

    def stored(self) -> tuple[dict, dict]:
        """(metadata, matrices): all there is to a snapshot."""
        meta = {"version": 2, "algorithm": self.algorithm, "metric": self.metric, "spherical": self.spherical, "k": self.k, "d": self.d, "input_dim": self.input_dim}
        meta |= {"preprocessing": "embedding_pipeline" if self.reducer is not None else "l2_normalize" if self.normalize else "none", "normalize": self.normalize, "features": self.features}
        meta |= {"sizes": [int(s) for s in self.sizes], "n_fitted": self.n_fitted, "calibrated": self.is_calibrated, "reduced": None}
        tables = {"centroids": self.centroids, "fit_mean": self.fit_mean, "percentiles": self.confidence_percentiles, "variances": self.variances, "kappas": self.kappas, "resultants": self.resultants}
        if self.reducer is not None:
            meta["reduced"] = {"method": self.reducer.method, "input_dim": self.reducer.input_dim, "target_dim": self.reducer.target_dim}
            tables |= {"components": self.reducer.components, "mean": self.reducer.mean}
        return meta, tables

    def save(self, spark: SparkSession, path: str) -> None:
        meta, tables = self.stored()
        save_vectors(spark, path, meta, **tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterSnapshot:
        return cls.restored(*load_vectors(spark, path))

    @classmethod
    def restored(cls, meta: dict, t: dict) -> ClusterSnapshot:
        from vecloom.operators.reduce import EmbeddingReducer

        if meta.get("version") not in (1, 2):
            raise ValueError(f"unknown snapshot version {meta.get('version')}")
        reducer = None
        if meta.get("reduced"):
            reducer = EmbeddingReducer(meta["reduced"]["target_dim"], meta["reduced"]["method"])
            reducer.input_dim, reducer.components = meta["reduced"]["input_dim"], t.get("components")
            reducer.mean = t["mean"][0] if "mean" in t else None
        out = cls(t["centroids"], meta["metric"], meta["spherical"], reducer, meta["normalize"], meta["algorithm"], meta["features"], meta["sizes"], t["fit_mean"][0], meta.get("n_fitted"))
        out.confidence_percentiles, out.variances = t.get("percentiles"), t.get("variances")
        out.kappas, out.resultants = (t[n][0] if n in t else None for n in ("kappas", "resultants"))
        return out

    def __repr__(self):
        return f"ClusterSnapshot(k={self.k}, d={self.d}, algorithm={self.algorithm!r}, metric={self.metric!r}, spherical={self.spherical}, calibrated={self.is_calibrated})"


def unit_percentiles(rows: DataFrame, shares: list[float], bins: int = 1 << 16) -> dict[int, list[float]]:
    """{label: exact percentiles, linear between ranks} of (label, value in [0, 1]).

    A histogram tells in which bin each wanted rank lies; only the values of those bins are counted one by
    one.  Both counts are pre-aggregated and no label's values are ever held together.
    """
    label, value = rows.columns
    table = materialized(rows.select(F.col(label).alias("label"), F.col(value).alias("v"), F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")), "confidences")
    by_bin, by_value = Window.partitionBy("label").orderBy("bin"), Window.partitionBy("label", "bin").orderBy("v")
    until = Window.unboundedPreceding, -1
    counts = table.df.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("label", "bin", "n", F.coalesce(F.sum("n").over(by_bin.rowsBetween(*until)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("label")).alias("total"))
    ranks = F.array_distinct(F.array(*[f(F.lit(p) * (F.col("total") - 1)) for p in shares for f in (F.floor, F.ceil)]))
    within = lambda start, n: F.filter("ranks", lambda r: (r >= start) & (r < start + n))
    hit = counts.withColumn("ranks", ranks).withColumn("ranks", within(F.col("before"), F.col("n"))).where(F.size("ranks") > 0)
    some = table.df.join(hit.drop("n"), ["label", "bin"]).groupBy("label", "bin", "v", "before", "total", "ranks").agg(F.count(F.lit(1)).alias("n"))
    some = some.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(by_value.rowsBetween(*until)), F.lit(0)))
    at: dict[int, dict[int, float]] = {}
    totals: dict[int, int] = {}
    for r in some.select("label", "v", "total", F.explode(within(F.col("start"), F.col("n"))).alias("rank")).collect():  # at most 2 a share and label
        at.setdefault(r["label"], {})[r["rank"]], totals[r["label"]] = r["v"], r["total"]
    table.drop()
    out = {}
    for j, found in at.items():
        places = [p * (totals[j] - 1) for p in shares]
        out[j] = [found[int(np.floor(q))] + (found[int(np.ceil(q))] - found[int(np.floor(q))]) * (q - np.floor(q)) for q in places]
    return out


def cluster_statistics(rows: DataFrame, k: int, d: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{label: (n, mean, sum of squared deviations)} of (label, x), merged pairwise so that large means
    do not swamp small spreads; k rows a partition are shuffled, k rows come back."""
    kind = "label long, n long, mean array<double>, m2 array<double>"

    def join(parts):
        n, mean, m2 = parts[0][0], np.array(parts[0][1]), np.array(parts[0][2])
        for n2, mean2, m22 in parts[1:]:
            gap, total = mean2 - mean, n + n2
            m2 = m2 + m22 + gap * gap * (n * n2 / total)
            mean, n = mean + gap * (n2 / total), total
        return n, mean, m2

    def batch(held: dict) -> pa.RecordBatch:
        ids = sorted(held)
        lists = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held[i][0] for i in ids], pa.int64()), pa.array([held[i][1].tolist() for i in ids], lists), pa.array([held[i][2].tolist() for i in ids], lists)], names=["label", "n", "mean", "m2"])

    def scan(batches):
        from vecloom.plans.frames import matrix_of

        held: dict = {}
        for b in batches:
            label, x = b.column(0).to_numpy(zero_copy_only=False), matrix_of(b.column(1))
            for j in np.unique(label):
                own = x[label == j]
                mean = own.mean(0)
                part = (len(own), mean, ((own - mean) ** 2).sum(0))
                held[int(j)] = join([held[int(j)], part]) if int(j) in held else part
        yield batch(held)

    def add(table: pa.Table) -> pa.Table:
        parts = [(r["n"], np.array(r["mean"]), np.array(r["m2"])) for r in table.to_pylist()]
        return pa.Table.from_batches([batch({table.column("label")[0].as_py(): join(parts)})])

    found = rows.select("label", "x").mapInArrow(scan, kind).groupBy("label").applyInArrow(add, kind).toArrow()
    return {r["label"]: (r["n"], np.array(r["mean"]), np.array(r["m2"])) for r in found.to_pylist()}
