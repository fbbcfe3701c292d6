"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a handful of joins and pre-aggregated group-bys over the edge table.  The table of
smallest neighbours is written before it is joined, so that the optimizer sees its size: it is
broadcast where small, and else the join is one whose skewed partitions (hubs) are split.  Nothing
about the graph reaches the driver but two numbers per round (row count and an order-free digest) that
tell whether the round changed anything - unless the caller allows up to ``local_edges`` counted edges
to be joined in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.plans.durable import Materialized, materialize, materialized


def _large_star(edges: DataFrame, rows: int) -> Materialized:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", 2 * rows)
    moved = both.join(low.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _written(moved, low, rows)


def _small_star(edges: DataFrame, rows: int) -> Materialized:
    low = materialized(edges.groupBy("u").agg(F.min("v").alias("m")), "low", rows)
    moved = edges.join(low.df, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _written(moved.unionByName(low.df.select("u", F.col("m").alias("v"))), low, rows)


def _written(edges: DataFrame, used: Materialized, rows: int) -> Materialized:
    """No star has more edges than it was made from, so ``rows`` bounds the files needed."""
    out = materialized(edges.distinct(), "edges", rows)
    used.drop()
    return out


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = 0) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest reachable node.

    Edges with a null end and self-loops carry no link and are ignored; direction and repeats do
    not matter.  An empty edge table gives an empty result.
    """
    ordered = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    current = materialized(ordered.distinct(), "edges")
    seen = _digest(current.df)
    if 0 < seen[0] <= local_edges:
        return _joined_here(current.df)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        spread = _large_star(current.df, seen[0])
        following = _small_star(spread.df, seen[0])
        found = _digest(following.df)
        spread.drop()
        current.drop()
        current = following
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.df.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return current.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _joined_here(edges: DataFrame) -> DataFrame:
    """The same for a counted, small number of edges."""
    parent: dict = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for row in edges.collect():
        a, b = find(row["u"]), find(row["v"])
        if a != b:
            parent[max(a, b)] = min(a, b)
    kind = edges.schema["u"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(v, find(v)) for v in parent], f"node {kind}, component {kind}")


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest member of each row's tree) after the rows a[k] and b[k] are linked."""
    a, b = root[a], root[b]
    while True:
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(higher := root[root], root):
            root = higher
        a, b = root[a], root[b]


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of distinct ``column`` numbered from 0 in its order, by ranges; the driver sees a count a range."""
    ranged = materialize(df.repartitionByRange(column).withColumn("range", F.spark_partition_id()), "ranges")
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "range int, start long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(column)) - 1 + F.col("start")
    return ranged.join(starts, "range").withColumn(name, place.cast("long")).drop("range", "start")
