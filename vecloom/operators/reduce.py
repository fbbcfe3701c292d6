"""Reducing embeddings: PCA from one pass of second moments or by a randomized range finder, and prefix truncation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import vectors as V
from vecloom.operators.assign import normalized
from vecloom.operators.kmeans import checked, load_vectors, save_vectors
from vecloom.plans.frames import NotFittedError, feature_frame, list_array, map_matrix, matrix_of, validate


def second_moments(frame: DataFrame, d: int, unit: bool = False, shift: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum of x, sum of x x') of the rows less ``shift`` in one pass: each partition multiplies its batches, pairs of partial
    sums are added on the executors by row of the matrix, and d rows reach the driver."""

    def scan(batches):
        total, outer, n = np.zeros(d), np.zeros((d, d)), 0
        for batch in batches:
            x = matrix_of(batch.column(0))
            if len(x):
                x = normalized(x) if unit else x
                x = x if shift is None else x - shift
                total += x.sum(0)
                outer += x.T @ x
                n += len(x)
        if n:
            rows = np.vstack([outer, total[None, :], np.full((1, d), n)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2)), list_array(rows)], names=["row", "values"])

    def add(table: pa.Table) -> pa.Table:
        values = np.sum(matrix_of(table.column("values").combine_chunks()), axis=0)
        return pa.table({"row": table.column("row")[:1], "values": list_array(values[None, :])})

    partial = frame.select("features").mapInArrow(scan, "row long, values array<double>")
    table = partial.groupBy("row").applyInArrow(add, "row long, values array<double>").toArrow().sort_by("row")
    m = matrix_of(table.column("values").combine_chunks())
    return int(round(m[d + 1, 0])), m[d], m[:d]


ROW_BLOCK = 1024
OVERSAMPLING, POWER_PASSES = 20, 7


def product_with(frame: DataFrame, basis: np.ndarray, shift: np.ndarray, unit: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum of y, sum of y (y' basis)) over y = x - shift, in one pass.

    A partition adds up d x l numbers; they are summed on the executors in blocks of ``ROW_BLOCK`` rows.
    Nothing of size d x d is made anywhere.
    """
    d, width = basis.shape
    shared = frame.sparkSession.sparkContext.broadcast((basis, shift))

    def scan(batches):
        basis, shift = shared.value
        held, n = np.zeros((d, width + 1)), 0
        for batch in batches:
            x = matrix_of(batch.column(0))
            if len(x):
                y = (normalized(x) if unit else x) - shift
                held[:, :width] += y.T @ (y @ basis)
                held[:, width] += y.sum(0)
                n += len(y)
        if n:
            begins = range(0, d, ROW_BLOCK)
            blocks = [held[s : s + ROW_BLOCK].tobytes() for s in begins]
            yield pa.RecordBatch.from_arrays([pa.array(list(begins), pa.int64()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["at", "n", "block"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for block in table.column("block").to_pylist():
            part = np.frombuffer(block)
            total = part.copy() if total is None else total + part
        return pa.table({"at": table.column("at")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    kind = "at long, n long, block binary"
    found = frame.select("features").mapInArrow(scan, kind).groupBy("at").applyInArrow(lambda table: add(table), kind).toArrow().sort_by("at")
    shared.unpersist()
    whole = np.concatenate([np.frombuffer(b).reshape(-1, width + 1) for b in found.column("block").to_pylist()])
    return found.column("n")[0].as_py(), whole[:, width], whole[:, :width]


def randomized_axes(frame: DataFrame, d: int, k: int, shift: np.ndarray, unit: bool, seed: int, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes d x k, variances) by subspace iteration from a random start (Halko, Martinsson and Tropp,
    2011): every pass multiplies the covariance with d x (k + oversampling) directions, which are made
    orthonormal by QR; the last gives the small matrix whose eigenvectors turn them into axes."""
    width = min(d, k + OVERSAMPLING)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for i in range(passes):
        n, total, product = product_with(frame, basis, shift, unit)
        off = total / n
        moved = (product - n * np.outer(off, off @ basis)) / max(1, n - 1)
        if i < passes - 1:
            basis = np.linalg.qr(moved)[0]
    small = basis.T @ moved
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return shift + off, (basis @ turn)[:, ::-1][:, :k], values[::-1][:k]


class EmbeddingReducer:
    """``pca``: leading eigenvectors of the covariance (exact; d up to a few thousand); ``randomized``: the same
    axes by a few passes with d x (k + 20) numbers, for any d; ``matryoshka``: the first dimensions.  Output
    vectors are unit length; input vectors are used as they are."""

    def __init__(self, target_dim: int = 128, method: str = "pca", random_state: int = 0, features: str = "features", ident: str = "id"):
        checked(target_dim=target_dim)
        if method not in ("pca", "randomized", "matryoshka"):
            raise ValueError("method is pca, randomized or matryoshka")
        self.target_dim, self.method, self.random_state, self.features, self.ident = target_dim, method, random_state, features, ident
        self.input_dim = self.components = self.mean = self.explained_variance_ = None

    def fit(self, df: DataFrame, unit: bool = False) -> EmbeddingReducer:
        frame = feature_frame(df, self.features, self.ident)
        n, d = validate(frame)
        if self.target_dim > d:
            raise ValueError(f"target_dim {self.target_dim} exceeds the {d} input dimensions")
        self.input_dim = d
        if self.method != "matryoshka":
            some = matrix_of(frame.select("features").limit(256).toArrow().column("features").combine_chunks())
            shift = (normalized(some) if unit else some).mean(axis=0)  # near the mean, so that little cancels
            if self.method == "randomized":
                self.mean, axes, values = randomized_axes(frame, d, self.target_dim, shift, unit, self.random_state, POWER_PASSES)
            else:
                n, total, outer = second_moments(frame, d, unit, shift)
                off = total / n
                self.mean = shift + off
                values, axes = np.linalg.eigh((outer - n * np.outer(off, off)) / max(1, n - 1))
                values, axes = values[::-1][: self.target_dim], axes[:, ::-1][:, : self.target_dim]
            axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)  # a fixed sign
            self.components, self.explained_variance_ = axes, values
        return self

    def project(self, x: np.ndarray) -> np.ndarray:
        if self.input_dim is None:
            raise NotFittedError("EmbeddingReducer is not fitted")
        if x.shape[1] != self.input_dim:
            raise ValueError(f"vectors have {x.shape[1]} dimensions, the reducer {self.input_dim}")
        return normalized((x - self.mean) @ self.components if self.method != "matryoshka" else x[:, : self.target_dim])

    def transform(self, df: DataFrame, name: str = "reduced") -> DataFrame:
        if self.input_dim is None:
            raise NotFittedError("EmbeddingReducer is not fitted")
        if self.method == "matryoshka":
            vector = F.col(self.features).cast("array<double>")
            guarded = F.when(F.size(vector) == self.input_dim, vector).otherwise(F.raise_error(F.lit("wrong number of dimensions")).cast("array<double>"))
            return df.withColumn(name, F.when(vector.isNotNull(), V.truncate(guarded, self.target_dim)))
        shared = df.sparkSession.sparkContext.broadcast(self)
        return map_matrix(df, self.features, [(name, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], lambda x: [list_array(shared.value.project(x))])

    def fit_transform(self, df: DataFrame, name: str = "reduced") -> DataFrame:
        return self.fit(df).transform(df, name)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.input_dim is None:
            raise NotFittedError("EmbeddingReducer is not fitted")
        meta = {"target_dim": self.target_dim, "method": self.method, "input_dim": self.input_dim, "features": self.features, "ident": self.ident, "version": 1}
        save_vectors(spark, path, meta, components=self.components, mean=self.mean, explained=self.explained_variance_)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EmbeddingReducer:
        meta, tables = load_vectors(spark, path)
        if meta.get("version") != 1:
            raise ValueError(f"unknown reducer version {meta.get('version')}")
        out = cls(meta["target_dim"], meta["method"], features=meta["features"], ident=meta["ident"])
        out.input_dim, out.components = meta["input_dim"], tables.get("components")
        out.mean, out.explained_variance_ = (tables[k][0] if k in tables else None for k in ("mean", "explained"))
        return out

    def __repr__(self):
        return f"EmbeddingReducer(target_dim={self.target_dim}, method={self.method!r}, fitted={self.input_dim is not None})"
