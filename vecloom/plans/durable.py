"""Cutting lineage with written tables in the folder all executors share.

Iterative plans (components, Lloyd rounds, Boruvka rounds) must not carry an ever longer lineage,
and must survive the loss of an executor.  ``materialize`` writes Parquet below
``spark.checkpoint.dir``; nothing here uses ``localCheckpoint`` or a machine-local folder.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


ROWS_PER_FILE = 200_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where that is unset.

    With ``local[...]`` masters (tests) a temporary folder is used; elsewhere a folder beside the SQL
    warehouse if that lies in a store all executors reach.  A cluster whose warehouse is a local path
    gets an error: each executor would write to its own disk, and later reads would miss those files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        own = tempfile.mkdtemp(prefix="vecloom-checkpoint-")
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if _on_local_disk(spark, warehouse):
            raise RuntimeError(f"intermediate tables need a folder that all executors share: set spark.checkpoint.dir (the warehouse {warehouse} is local)")
        own = warehouse.rstrip("/") + "/_vecloom_checkpoint"
    spark.sparkContext.setCheckpointDir(own)
    return (spark.sparkContext.getCheckpointDir() or own).rstrip("/")


def _on_local_disk(spark: SparkSession, path: str) -> bool:
    """Whether a path names each machine's own disk; without a scheme the default file system decides."""
    scheme = urlparse(path).scheme or urlparse(spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "").scheme
    return scheme in ("", "file")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Materialized:
    """A written intermediate table; ``drop()`` once a later one has replaced it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df: DataFrame = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def materialized(df: DataFrame, label: str = "table", rows: int | None = None) -> Materialized:
    """Write ``df``; where a bound of its ``rows`` is known, into no more files than they need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    path = f"{checkpoint_root(spark)}/vecloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Materialized(spark, path, df.schema)


def materialize(df: DataFrame, label: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` once below the checkpoint folder and return a scan of what was written."""
    return materialized(df, label, rows).df
