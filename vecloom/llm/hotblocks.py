"""Exact handling of buckets too large for one task.

A similarity join looks up *probe* rows in buckets of *index* rows.  A bucket with more than
``block_rows`` index rows is *hot*: its rows are dealt into chunks by a hash of their id, and every
(index chunk, probe chunk) pair becomes one small group of its own.  A group holds at most about
``2 * block_rows`` rows however large the bucket is, the comparison inside it is vectorised, and what
it gives back is linear in its rows (a spanning forest of its links, or counts by row) - never the
pairs themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.plans.durable import materialize


def hot_buckets(index: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Keys of buckets with more than ``block_rows`` index rows, with that count as ``n_index``."""
    counts = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_index")).where(F.col("n_index") > block_rows)
    return materialize(counts, "hot")


def cold_rows(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(hot.select(*keys), keys, "left_anti")


def block_pairs(index: DataFrame, probe: DataFrame, hot: DataFrame, keys: list[str], ident: Column, block_rows: int):
    """Rows of hot buckets as groups: grouped by the keys and a pair of chunks, with ``is_probe`` set.

    ``index`` and ``probe`` have the same columns.  Returns the GroupedData for applyInPandas.
    """
    sizes = (
        probe.join(hot, keys)
        .groupBy(*keys, "n_index")
        .agg(F.count(F.lit(1)).alias("n_probe"))
        .select(
            *keys,
            F.ceil(F.col("n_index") / block_rows).cast("int").alias("ci"),
            F.ceil(F.col("n_probe") / block_rows).cast("int").alias("cp"),
        )
    )
    sizes = materialize(sizes, "hot-sizes")

    def dealt(rows: DataFrame, own: str, other: str, flag: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64(ident, F.lit(11)), F.col(own)).cast("int")
        placed = rows.join(sizes, keys).select(
            *rows.columns, mine.alias(f"b{own[1]}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"b{other[1]}")
        )
        return placed.select(*rows.columns, "bi", "bp", F.lit(flag).alias("is_probe"))

    return dealt(index, "ci", "cp", False).unionByName(dealt(probe, "cp", "ci", True)).groupBy(*keys, "bi", "bp")


def forest(linked: np.ndarray, probe_ids: np.ndarray, index_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component in this block) for a probe x index matrix of links."""
    if not linked.any():
        return np.array([], probe_ids.dtype), np.array([], probe_ids.dtype)
    ids, back = np.unique(np.concatenate([probe_ids, index_ids]), return_inverse=True)
    p, i = back[: len(probe_ids)], back[len(probe_ids):]
    a, b = np.nonzero(linked)
    a, b = p[a], i[b]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
