"""Feature frames: validation, conversion between Arrow batches and matrices, bounded collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_BYTES = 16 << 20  # matrices up to this size may be worked on in one place


class NotFittedError(RuntimeError):
    """The model is used before it was fitted."""


def features_of(*columns: str) -> Column:
    """Scalar columns as one feature vector."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def feature_frame(df: DataFrame, features: str = "features", ident: str = "id") -> DataFrame:
    """(id, features ARRAY<DOUBLE>)."""
    kind = df.schema[features].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise ValueError(f"{features} must be an array of numbers, one row a sample")
    return df.select(F.col(ident).alias("id"), F.col(features).cast("array<double>").alias("features"))


def validate(frame: DataFrame) -> tuple[int, int]:
    """(rows, dimensions) after one aggregate; empty, ragged or non-finite input raises ValueError."""
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = frame.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("features")).alias("low"),
        F.max(F.size("features")).alias("high"),
        F.max(F.coalesce(bad, F.lit(True)).cast("int")).alias("bad"),
    ).first()
    if not row["n"]:
        raise ValueError("the input is empty")
    if row["bad"]:
        raise ValueError("the input holds null, NaN or infinite values")
    if row["low"] != row["high"] or not row["high"]:
        raise ValueError("all vectors must have the same, positive number of dimensions")
    return row["n"], row["high"]


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows x dims matrix of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def list_array(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def map_matrix(df: DataFrame, features: str, added: list[tuple[str, T.DataType, pa.DataType]], compute: Callable[[np.ndarray], list[np.ndarray | pa.Array]]) -> DataFrame:
    """``df`` with columns computed from its feature matrix, batch by batch; all columns pass through.

    ``compute`` may hold broadcast models; rows whose vector is null get nulls.
    """
    names = [a[0] for a in added]
    clash = {n.lower() for n in names} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    temporary = "__features"
    while temporary.lower() in {c.lower() for c in df.columns}:
        temporary += "_"
    rows = df.withColumn(temporary, F.col(features).cast("array<double>"))
    at = len(df.columns)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k, _ in added]])
    kinds = [k for _, _, k in added]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(at)
            known = np.nonzero(np.asarray(vectors.is_valid()))[0]
            made = compute(matrix_of(vectors.take(pa.array(known)) if len(known) < len(vectors) else vectors)) if len(known) else [pa.array([], k) for k in kinds]
            arrays = [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, k) for m, k in zip(made, kinds)]
            if len(known) < len(vectors):
                back = np.full(len(vectors), -1)
                back[known] = np.arange(len(known))
                where = pa.array(back, mask=back < 0)
                arrays = [a.take(where) if len(a) else pa.nulls(len(vectors), k) for a, k in zip(arrays, kinds)]
            fields = [*list(batch.schema)[:at], *[pa.field(n, k) for n, k in zip(names, kinds)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *arrays], schema=pa.schema(fields))

    return rows.mapInArrow(scan, schema)


def collect_matrix(frame: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and matrix of a small frame, in id order; callers check the size first."""
    table = frame.orderBy("id").toArrow()
    return table.column("id").to_pylist(), matrix_of(table.column("features").combine_chunks())
