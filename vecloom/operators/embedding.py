"""Embedding clusters: normalize, reduce, spherical k-means, evaluate; von Mises-Fisher refinement."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import directional as D
from vecloom.operators import metrics
from vecloom.operators.assign import normalized
from vecloom.operators.kmeans import CentroidModel, _Clusterer, checked, load_vectors, save_vectors
from vecloom.operators.lloyd import BOUNDS_FROM, LocalRows, lloyd, partial_sums, rows_of, starts
from vecloom.operators.reduce import EmbeddingReducer
from vecloom.plans.durable import materialize
from vecloom.plans.frames import LOCAL_BYTES, NotFittedError, feature_frame, list_array, map_matrix, matrix_of, validate


class EmbeddingCluster(_Clusterer):
    """k-means on the unit sphere after an optional reduction.

    ``algorithm``: ``full`` passes over all rows (the default; with bounds kept beside them from ``BOUNDS_FROM``
    clusters on), ``hamerly`` (such bounds at any size, the same centres) or ``minibatch`` (the running resultant of
    each cluster blends with the sum of its rows in a sampled batch by weight n_batch / (n + n_batch),
    counts from 1; the centre is its direction; ends after ten rounds of little change).
    """

    def __init__(self, n_clusters: int = 50, reduction_dim: int | None = 128, max_iter: int = 100, tol: float = 1e-6, random_state: int = 0, n_init: int = 5, reduction: str = "pca", init="k-means++", features: str = "features", ident: str = "id", algorithm: str = "full", batch_size: int = 1024, local_bytes: int = LOCAL_BYTES):
        checked(n_clusters=n_clusters, max_iter=max_iter, n_init=n_init, batch_size=batch_size)
        if reduction not in ("pca", "randomized", "matryoshka", "none"):
            raise ValueError("reduction is pca, randomized, matryoshka or none")
        self.n_clusters, self.reduction_dim, self.max_iter, self.tol, self.random_state, self.n_init = n_clusters, reduction_dim, max_iter, tol, random_state, n_init
        self.reduction, self.init, self.features, self.ident, self.algorithm, self.batch_size, self.local_bytes = reduction, init, features, ident, algorithm, batch_size, local_bytes
        self.metric, self.reducer = "dot", None
        self.probabilities_ = self.concentrations_ = self.bic_ = None
        self.reduced_data_ = self.telemetry_ = None

    def fit(self, df: DataFrame) -> EmbeddingCluster:
        frame = feature_frame(df, self.features, self.ident)
        n, d = validate(frame)
        if self.n_clusters > n:
            raise ValueError(f"{self.n_clusters} clusters asked of {n} rows")
        self.reducer = None
        if self.reduction != "none" and self.reduction_dim and self.reduction_dim < d:
            self.reducer = EmbeddingReducer(self.reduction_dim, self.reduction).fit(frame, unit=True)
        self.input_dim, dims = d, self.reducer.target_dim if self.reducer else d
        shared = frame.sparkSession.sparkContext.broadcast(self.reducer)

        def ready(x):
            x = normalized(x)
            return [list_array(shared.value.project(x) if shared.value is not None else x)]

        made = map_matrix(frame, "features", [("made", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], ready)
        self.reduced_data_ = materialize(made.select("id", F.col("made").alias("features")), "reduced")
        rows = rows_of(self.reduced_data_, n, dims, self.local_bytes)
        if isinstance(self.init, str) and self.init == "k-means++":
            begun = starts(rows, self.n_clusters, [self.random_state + i for i in range(self.n_init)], "dot")
        else:
            begun = [normalized(s) for s in self._starts(rows, [self.random_state])]
        log: list = []
        self.distance_shares_: list[float] = []
        if self.algorithm == "minibatch":
            runs = [self._minibatch(rows, s, k, log) for k, s in enumerate(begun)]
        else:
            runs = lloyd(rows, begun, "dot", self.max_iter, self.tol, spherical=True, log=log, bounds=self.algorithm == "hamerly" or self.n_clusters >= BOUNDS_FROM, measured=self.distance_shares_)
        centres, cost, rounds = runs[min(range(len(runs)), key=lambda i: (runs[i][1], i))]
        self.model = CentroidModel(centres, cost, rounds, "dot", "embedding", "features", "id")
        self.model._fitted_on = self.reduced_data_
        self.objective_ = -cost
        kind = "run long, iteration long, objective double, relative_change double, churn double, shift double, milliseconds double"
        self.telemetry_ = frame.sparkSession.createDataFrame([(r, i, -c, *rest) for r, i, c, *rest in log], kind)
        self.intra_similarity_, self.resultant_lengths_ = self._evaluate()
        self.probabilities_ = self.concentrations_ = self.bic_ = None
        return self

    def _minibatch(self, rows, start, run: int, log: list):
        c, resultants, counts = start.copy(), start.copy(), np.ones(len(start))
        before, still, done = -np.inf, 0, 0
        for i in range(self.max_iter):
            began = time.perf_counter()
            seed = (self.random_state + run) * 100_003 + i + 1
            found = partial_sums(rows.batch(self.batch_size, seed), [c], "dot")[0]
            c, resultants, counts = spherical_minibatch_step(c, resultants, counts, found.n, found.total)
            objective, done = -float(found.cost.sum()), i + 1
            change = abs(objective - before) / abs(before) if np.isfinite(before) and abs(before) > 1e-30 else float("inf")
            still = still + 1 if i > 0 and self.tol > 0 and change < self.tol else 0
            before = objective
            log.append((run, done, -objective, float(change), 0.0, 0.0, 1000 * (time.perf_counter() - began)))
            if still >= 10:
                break
        return c, float(rows.round([c], "dot")[0].cost.sum()), done

    def _evaluate(self) -> tuple[np.ndarray, np.ndarray]:
        from vecloom.operators.snapshot import cluster_statistics

        k = self.n_clusters
        labelled = self.model.transform(self.reduced_data_).select("label", F.col("features").alias("x"))
        stats = cluster_statistics(labelled, k, self.model.cluster_centers_.shape[1])
        intra, length, self.sizes_ = np.zeros(k), np.zeros(k), np.zeros(k)
        for j, (size, mean, _) in stats.items():
            self.sizes_[j] = size
            intra[j], length[j] = float(mean @ self.model.cluster_centers_[j]), float(np.linalg.norm(mean))
        return intra, length

    @property
    def representatives_(self) -> DataFrame:
        """(label, id) of the row nearest each centre, the smallest id on ties."""
        return metrics.representatives(self.model.transform(self._reduced()), self.model.cluster_centers_)

    def _reduced(self) -> DataFrame:
        if self.model is None:
            raise NotFittedError("EmbeddingCluster is not fitted")
        if self.reduced_data_ is None:
            raise NotFittedError("the reduced rows belong to a model fitted in this session")
        return self.reduced_data_

    def refine_vmf(self, df: DataFrame | None = None, max_iter: int = 50, tol: float = 1e-6, hard: bool = False) -> EmbeddingCluster:
        """Soft assignments by a von Mises-Fisher mixture, from the hard clusters on.

        The E-step sums responsibilities, weighted rows and the log-likelihood inside each partition;
        k x d numbers a partition are added on the executors.  ``hard`` gives whole rows to the best.
        """
        frame = self._reduced()
        k, d = self.model.cluster_centers_.shape
        n = frame.count()
        means = self.model.cluster_centers_.copy()
        sizes = np.zeros(k)
        for r in self.labels_.groupBy("label").count().collect():
            sizes[r["label"]] = r["count"]
        weights = np.maximum(sizes / n, 1e-10)
        weights /= weights.sum()
        kappas = np.array([D.estimate_kappa(r, d) for r in self.resultant_lengths_])
        rows = rows_of(frame, n, d, self.local_bytes)
        before, loglik = -np.inf, -np.inf
        for _ in range(max_iter):
            resp, total, loglik = e_step_sums(rows, means, kappas, weights, hard)
            weights = np.maximum(resp / n, 1e-10)
            weights /= weights.sum()
            for j in range(k):
                length = float(np.linalg.norm(total[j]))
                if resp[j] > 1e-10 and length > 0:
                    means[j] = total[j] / length
                    kappas[j] = D.estimate_kappa(length / resp[j], d)
            if np.isfinite(before) and abs(loglik - before) <= tol * abs(before):
                break
            before = loglik
        self.vmf_means_, self.vmf_weights_, self.concentrations_ = means, weights, kappas
        self.log_likelihood_ = loglik
        self.bic_ = -2 * loglik + (k * (d - 1) + k + (k - 1)) * math.log(n)
        return self

    def soft_assign(self, name: str = "probabilities") -> DataFrame:
        """(id, probabilities) of the fitted rows under the refined mixture."""
        if self.concentrations_ is None:
            raise NotFittedError("refine_vmf comes first")
        frame = self._reduced()
        shared = frame.sparkSession.sparkContext.broadcast((self.vmf_means_, self.concentrations_, self.vmf_weights_))
        made = map_matrix(frame, "features", [(name, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], lambda x: [list_array(responsibilities(x, *shared.value)[0])])
        return made.select("id", name)

    _settings = ("n_clusters", "reduction_dim", "max_iter", "tol", "random_state", "n_init", "reduction", "features", "ident", "algorithm", "batch_size", "local_bytes")
    _numbers = ("objective_", "bic_", "log_likelihood_", "input_dim")
    _vectors = ("intra_similarity_", "resultant_lengths_", "sizes_", "vmf_means_", "vmf_weights_", "concentrations_")

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted model with its reducer, mixture and telemetry, but not the reduced rows: assignment,
        snapshots and ``predict`` work on what is loaded, ``labels_`` and refinement belong to the fit."""
        model, telemetry = self._known(), self.telemetry_
        meta = {"version": 1, "settings": {k: getattr(self, k) for k in self._settings}, "numbers": {k: getattr(self, k, None) for k in self._numbers}, "n_iter": model.n_iter_, "inertia": model.inertia_, "reduced": self.reducer is not None}
        save_vectors(spark, f"{path}/model", meta, centroids=model.cluster_centers_, **{k: getattr(self, k, None) for k in self._vectors})
        if self.reducer is not None:
            self.reducer.save(spark, f"{path}/reducer")
        if telemetry is not None:
            telemetry.coalesce(1).write.mode("overwrite").parquet(f"{path}/telemetry")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EmbeddingCluster:
        meta, tables = load_vectors(spark, f"{path}/model")
        if meta.get("version") != 1:
            raise ValueError(f"unknown model version {meta.get('version')}")
        out = cls(**meta["settings"])
        out.reducer = EmbeddingReducer.load(spark, f"{path}/reducer") if meta["reduced"] else None
        out.model = CentroidModel(tables["centroids"], meta["inertia"], meta["n_iter"], "dot", "embedding", "features", "id")
        for name, value in meta["numbers"].items():
            setattr(out, name, value)
        for name in cls._vectors:
            value = tables.get(name)
            setattr(out, name, value if value is None or name == "vmf_means_" else value[0])
        out.telemetry_ = spark.read.parquet(f"{path}/telemetry")
        return out

    def __getstate__(self):
        """Everything but the reduced rows and the telemetry table, which belong to a session."""
        return self.__dict__ | {"reduced_data_": None, "telemetry_": None}

    def predict(self, df: DataFrame, name: str = "label") -> DataFrame:
        """``df`` with the number of the centre nearest to each normalized, reduced row."""
        return self.snapshot().assign(df).withColumnRenamed("label", name)

    def snapshot(self):
        from vecloom.operators.snapshot import ClusterSnapshot

        self._known()
        counts = dict(enumerate(self.sizes_))
        return ClusterSnapshot(self.model.cluster_centers_, spherical=True, reducer=self.reducer, algorithm="embedding", features=self.features, sizes=[int(counts.get(j, 0)) for j in range(self.n_clusters)], fit_mean=self.intra_similarity_)


def spherical_minibatch_step(c: np.ndarray, resultants: np.ndarray, counts: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, resultants, counts) after a batch with n rows and their sum for each cluster."""
    rate = np.where(n > 0, n / (counts + n), 0.0)[:, None]
    resultants = (1 - rate) * resultants + rate * total
    length = np.linalg.norm(resultants, axis=1)
    turned = (n > 0) & (length * length > 1e-30)
    c = c.copy()
    c[turned] = resultants[turned] / length[turned, None]
    return c, resultants, counts + n


def responsibilities(x: np.ndarray, means: np.ndarray, kappas: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows of cluster probabilities and the log-likelihood."""
    d = means.shape[1]
    offset = np.log(weights) + np.array([D.log_normalizer(float(c), d) for c in kappas])
    logp = (x @ means.T) * kappas[None, :] + offset[None, :]
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    mass = p.sum(axis=1, keepdims=True)
    return p / mass, float((top + np.log(mass)).sum())


def _sums(x, means, kappas, weights, hard):
    p, ll = responsibilities(x, means, kappas, weights)
    if hard:
        best = p.argmax(axis=1)
        p = np.zeros_like(p)
        p[np.arange(len(x)), best] = 1
    return np.vstack([np.hstack([p.T @ x, p.sum(0)[:, None]]), np.full((1, x.shape[1] + 1), ll)])


def e_step_sums(rows, means, kappas, weights, hard: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(responsibility sums, responsibility-weighted sums of rows, log-likelihood)."""
    k, d = means.shape
    if isinstance(rows, LocalRows):
        total = _sums(rows.x, means, kappas, weights, hard)
    else:
        shared = rows.frame.sparkSession.sparkContext.broadcast((means, kappas, weights))

        def scan(batches):
            held = np.zeros((k + 1, d + 1))
            for b in batches:
                if b.num_rows:
                    held += _sums(matrix_of(b.column(0)), *shared.value, hard)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), list_array(held)], names=["row", "values"])

        def add(table):
            return pa.table({"row": table.column("row")[:1], "values": list_array(matrix_of(table.column("values").combine_chunks()).sum(0)[None, :])})

        kind = "row long, values array<double>"
        table = rows.frame.select("features").mapInArrow(scan, kind).groupBy("row").applyInArrow(add, kind).toArrow().sort_by("row")
        total = matrix_of(table.column("values").combine_chunks())
    return total[:k, d], total[:k, :d], float(total[k, 0])
