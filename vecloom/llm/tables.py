"""Small helpers the operators share: reading tables and picking column names that clash with nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df_or_columns, stem: str) -> str:
    """``stem``, or ``stem`` with underscores, that is no column yet (case does not tell names apart)."""
    columns = df_or_columns.columns if isinstance(df_or_columns, DataFrame) else df_or_columns
    taken = {c.lower() for c in columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as one identifier, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def mapped(rows: DataFrame, scan, schema: T.StructType) -> DataFrame:
    """``rows.mapInArrow``, which by itself takes no column names with dots or backticks: those pass through
    under plain names."""
    odd = [c for c in rows.columns if "." in c or "`" in c]
    if not odd:
        return rows.mapInArrow(scan, schema)
    plain: dict[str, str] = {}
    for c in odd:
        plain[c] = free_name([*rows.columns, *plain.values()], "odd")
    kept = T.StructType([T.StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])
    return rows.toDF(*[plain.get(c, c) for c in rows.columns]).mapInArrow(scan, kept).toDF(*schema.names)


def _comparable(value: Column, kind: T.DataType) -> Column:
    """A value without maps: those as entries in order of their keys, wherever they are nested."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_comparable(e["key"], kind.keyType).alias("key"), _comparable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _comparable(x, kind.elementType)) if _holds_map(kind.elementType) else value
    if isinstance(kind, T.StructType) and _holds_map(kind):
        fields = [_comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return F.to_json(value) if "Variant" in type(kind).__name__ else value


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or "Variant" in type(kind).__name__


def row_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    """64 bits of a row's columns; maps count by their entries, and nulls by where they are."""
    kinds = {f.name: f.dataType for f in df.schema}
    values = [F.col(quoted(c)) for c in columns]
    return F.xxhash64(*[_comparable(v, kinds[c]) for v, c in zip(values, columns)], *[v.isNull() for v in values], F.lit(seed))
