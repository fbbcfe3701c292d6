"""Saving and loading of models whose result is one row per input row: tables, not pickles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class StoredModel:
    """``save`` writes the settings as one JSON row and every table of ``_tables`` as Parquet below a path.

    The class names its settings in ``_saved`` and restores its tables in ``_restore``.  A model that is
    not fitted is saved without tables.  Saving to a path that exists raises Spark's error.
    """

    _saved: tuple[str, ...] = ()

    def _tables(self) -> dict[str, DataFrame]:
        raise NotImplementedError

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        tables = self._tables()
        held = {"kind": type(self).__name__, "tables": sorted(tables), "settings": {k: getattr(self, k) for k in self._saved if hasattr(self, k)}}
        spark.createDataFrame([(json.dumps(held),)], "model string").coalesce(1).write.parquet(f"{path}/model")
        for name, table in tables.items():
            table.write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        held = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        if held["kind"] != cls.__name__:
            raise ValueError(f"{path} holds a {held['kind']}, not a {cls.__name__}")
        model = cls()
        for name, value in held["settings"].items():
            setattr(model, name, value)
        model._restore({name: spark.read.parquet(f"{path}/{name}") for name in held["tables"]})
        return model

    def __getstate__(self):
        if any(isinstance(v, (DataFrame, SparkSession)) for v in self.__dict__.values()):
            raise TypeError(f"a fitted {type(self).__name__} holds distributed tables; use save and load")
        return self.__dict__
