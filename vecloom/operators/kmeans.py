"""k-means, mini-batch k-means and their models."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import parse_metric
from vecloom.operators.assign import assign
from vecloom.operators.lloyd import BOUNDS_FROM, lloyd, rows_of, starts
from vecloom.plans.frames import LOCAL_BYTES, NotFittedError, feature_frame, validate


def checked(**values) -> None:
    """Positive integers by name; anything else raises ValueError."""
    for name, value in values.items():
        if not isinstance(value, (int, np.integer)) or isinstance(value, bool) or value < 1:
            raise ValueError(f"{name} must be a positive integer, not {value!r}")


def save_vectors(spark: SparkSession, path: str, metadata: dict, **tables: np.ndarray) -> None:
    """A model directory: one Parquet table of (kind, row, values), one of the metadata JSON."""
    rows = [(kind, i, [float(v) for v in row]) for kind, m in tables.items() if m is not None for i, row in enumerate(np.atleast_2d(m))]
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("row", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "vectors"))
    spark.createDataFrame([(json.dumps(metadata),)], "metadata string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "metadata"))


def load_vectors(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    metadata = json.loads(spark.read.parquet(os.path.join(path, "metadata")).first()["metadata"])
    tables: dict[str, list] = {}
    for r in spark.read.parquet(os.path.join(path, "vectors")).orderBy("kind", "row").collect():
        tables.setdefault(r["kind"], []).append(r["values"])
    return metadata, {k: np.array(v) for k, v in tables.items()}


class CentroidModel:
    """Fitted centroids with their cost; what transform, snapshot and save need."""

    def __init__(self, centroids, inertia: float, n_iter: int, metric: str, algorithm: str, features: str = "features", ident: str = "id"):
        self.cluster_centers_ = np.asarray(centroids, dtype=np.float64)
        self.inertia_, self.n_iter_, self.metric, self.algorithm = float(inertia), int(n_iter), metric, algorithm
        self.features, self.ident = features, ident
        self._fitted_on: DataFrame | None = None

    def transform(self, df: DataFrame, name: str = "label") -> DataFrame:
        return assign(df, self.cluster_centers_, self.metric, self.features, name)

    predict = transform

    @property
    def labels_(self) -> DataFrame:
        """(id, label) of the rows the model was fitted on."""
        if self._fitted_on is None:
            raise NotFittedError("labels_ belongs to a model fitted in this session")
        return self.transform(self._fitted_on).select(F.col(self.ident).alias("id"), "label")

    def snapshot(self):
        from vecloom.operators.snapshot import ClusterSnapshot

        counts = {r["label"]: r["count"] for r in self.labels_.groupBy("label").count().collect()} if self._fitted_on is not None else {}
        return ClusterSnapshot(self.cluster_centers_, self.metric, algorithm=self.algorithm, features=self.features, sizes=[counts.get(k, 0) for k in range(len(self.cluster_centers_))])

    def save(self, spark: SparkSession, path: str) -> None:
        save_vectors(spark, path, {"kind": self.algorithm, "inertia": self.inertia_, "n_iter": self.n_iter_, "metric": self.metric, "features": self.features, "ident": self.ident}, centroids=self.cluster_centers_)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CentroidModel:
        m, t = load_vectors(spark, path)
        return cls(t["centroids"], m["inertia"], m["n_iter"], m["metric"], m["kind"], m["features"], m["ident"])

    def __getstate__(self):
        return self.__dict__ | {"_fitted_on": None}

    def __repr__(self):
        return f"{type(self).__name__}({self.algorithm}, k={len(self.cluster_centers_)}, metric={self.metric!r}, inertia={self.inertia_:.6g})"


class _Clusterer:
    """Shared arguments; fitting keeps the model so that sklearn-style attributes work."""

    model: CentroidModel | None = None

    def _rows(self, df: DataFrame):
        frame = feature_frame(df, self.features, self.ident)
        n, d = validate(frame)
        if self.n_clusters > n:
            raise ValueError(f"{self.n_clusters} clusters asked of {n} rows")
        return rows_of(frame, n, d, self.local_bytes)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).labels_

    def predict(self, df: DataFrame) -> DataFrame:
        return self._known().transform(df)

    def snapshot(self):
        return self._known().snapshot()

    def _known(self) -> CentroidModel:
        if self.model is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        return self.model

    def __getattr__(self, name):
        if name in ("labels_", "cluster_centers_", "inertia_", "n_iter_"):
            return getattr(self._known(), name)
        raise AttributeError(name)

    def _starts(self, rows, seeds) -> list[np.ndarray]:
        if isinstance(self.init, str):
            if self.init == "first_k":
                return [rows.first(self.n_clusters)]
            if self.init != "k-means++":
                raise ValueError("init is k-means++, first_k or an array")
            return starts(rows, self.n_clusters, seeds, self.metric)
        given = np.asarray(self.init, dtype=np.float64)
        if given.shape != (self.n_clusters, rows.d):
            raise ValueError(f"init must be {self.n_clusters} x {rows.d}")
        return [given]


class KMeans(_Clusterer):
    """Lloyd's algorithm with restarts.

    ``algorithm``: ``lloyd`` measures every distance in every round, ``hamerly`` keeps bounds beside the rows and
    measures those in doubt (``operators/bounds.py``), ``auto`` keeps them from ``BOUNDS_FROM`` clusters on; the
    labels and centroids are the same.  ``distance_shares_`` holds the share measured in each round.
    Restarts draw their starts by scalable k-means++ over all rows, the same ones whether rows are held
    or distributed, and are iterated together; the lowest cost wins, the first on ties.
    """

    def __init__(self, n_clusters: int, max_iter: int = 300, tol: float = 1e-4, random_state: int = 0, n_init: int = 10, algorithm: str = "auto", metric: str = "euclidean", init="k-means++", features: str = "features", ident: str = "id", local_bytes: int = LOCAL_BYTES):
        checked(n_clusters=n_clusters, max_iter=max_iter, n_init=n_init)
        if not tol >= 0:
            raise ValueError("tol must not be negative")
        if algorithm not in ("auto", "lloyd", "hamerly"):
            raise ValueError("algorithm is auto, lloyd or hamerly")
        self.n_clusters, self.max_iter, self.tol, self.random_state, self.n_init = n_clusters, max_iter, tol, random_state, n_init
        self.algorithm, self.metric, self.init, self.features, self.ident, self.local_bytes = algorithm, parse_metric(metric), init, features, ident, local_bytes

    def fit(self, df: DataFrame) -> CentroidModel:
        rows = self._rows(df)
        bounds = self.algorithm == "hamerly" or self.algorithm == "auto" and self.n_clusters >= BOUNDS_FROM
        self.distance_shares_: list[float] = []
        begun = self._starts(rows, [self.random_state + i for i in range(self.n_init)])
        runs = lloyd(rows, begun, self.metric, self.max_iter, self.tol, bounds=bounds, measured=self.distance_shares_)
        best = min(range(len(runs)), key=lambda i: (runs[i][1], i))
        self.model = CentroidModel(*runs[best], self.metric, "kmeans", self.features, self.ident)
        self.model._fitted_on = df
        return self.model


class MiniBatchKMeans(_Clusterer):
    """Running means over sampled batches: c' = (n c + sum of the batch) / (n + rows of the batch).

    Counts start at 0, so the first rows replace the start.  Early stopping needs ``tol`` > 0: the
    exponentially weighted batch cost must change by less than ``tol`` for ``max_no_improvement``
    rounds.  Batches are bounded by ``batch_size`` and update k x d numbers on the driver; only the
    final assignment reads all rows.
    """

    def __init__(self, n_clusters: int, batch_size: int = 1024, max_iter: int = 100, tol: float = 0.0, random_state: int = 0, max_no_improvement: int = 10, metric: str = "euclidean", init="k-means++", features: str = "features", ident: str = "id", local_bytes: int = LOCAL_BYTES):
        checked(n_clusters=n_clusters, batch_size=batch_size, max_iter=max_iter, max_no_improvement=max_no_improvement)
        if not tol >= 0:
            raise ValueError("tol must not be negative")
        self.n_clusters, self.batch_size, self.max_iter, self.tol, self.random_state = n_clusters, batch_size, max_iter, tol, random_state
        self.max_no_improvement, self.metric, self.init, self.features, self.ident, self.local_bytes = max_no_improvement, parse_metric(metric), init, features, ident, local_bytes

    def fit(self, df: DataFrame) -> CentroidModel:
        from vecloom.operators.lloyd import partial_sums

        rows = self._rows(df)
        c = np.array(self._starts(rows, [self.random_state])[0])
        counts = np.zeros(len(c))
        smooth, still, rounds = None, 0, 0
        for i in range(self.max_iter):
            x = rows.batch(self.batch_size, self.random_state * 100_003 + i + 1)
            found = partial_sums(x, [c], self.metric)[0]
            cost = float(found.cost.sum()) / max(1, len(x))
            c, counts = minibatch_step(c, counts, found.n, found.total)
            rounds += 1
            before, smooth = smooth, cost if smooth is None else 0.9 * smooth + 0.1 * cost
            if self.tol > 0 and before is not None:
                still = still + 1 if abs(before - smooth) <= self.tol * max(abs(before), 1e-30) else 0
                if still >= self.max_no_improvement:
                    break
        final = rows.round([c], self.metric)[0]
        self.model = CentroidModel(c, float(final.cost.sum()), rounds, self.metric, "minibatch_kmeans", self.features, self.ident)
        self.model._fitted_on = df
        return self.model


def minibatch_step(c: np.ndarray, counts: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One update from the rows and their sums a centroid in a batch."""
    held = n > 0
    c, after = c.copy(), counts + n
    c[held] = (counts[held, None] * c[held] + total[held]) / after[held, None]
    return c, after
