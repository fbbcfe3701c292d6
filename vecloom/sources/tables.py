"""Reading feature tables from files, databases and arrays, and writing results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.plans.frames import features_of

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")


def read(spark: SparkSession, source: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A table in any of Spark's built-in formats; text formats want a schema rather than inference."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(dbtable=source).load() if format == "jdbc" else reader.load(source)


def from_columns(df: DataFrame, columns: list[str], ident: str, name: str = "features") -> DataFrame:
    """``df`` with scalar columns gathered into a vector (null where any is null)."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return df.withColumn(name, F.when(known, features_of(*columns))).withColumn("id", F.col(ident).cast("long"))


def from_numpy(spark: SparkSession, x, dtype: str | None = None) -> DataFrame:
    """(id, features) of a two-dimensional array; float32 stays float, all else becomes double."""
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError("the array must have two dimensions, one row a sample")
    kind = dtype or ("float" if x.dtype == np.float32 else "double")
    x = np.ascontiguousarray(x, dtype={"float": np.float32, "double": np.float64}.get(kind, np.float64))
    ends = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int64)[: len(x) + 1])
    rows = pa.table({"id": pa.array(np.arange(len(x))), "features": pa.LargeListArray.from_arrays(ends, pa.array(x.ravel()))})
    return spark.createDataFrame(rows, f"id long, features array<{kind}>")


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
