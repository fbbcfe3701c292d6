"""Ward linkage beyond one matrix: rounds that merge all pairs of clusters nearest to each other.

Ward's heights are reducible (a merge never comes nearer to a third cluster than its parts were), so
clusters that are each other's nearest may merge at once and the tree is that of one merge at a time.
A cluster is its centroid and size; its nearest is sought in the cells of ``pivots.py``: sizes are at
least 1, so a bound of the centroids' distance and the cell's sizes bounds the height.  Equal rows
merge first, at height 0.  Nothing but one row a cell reaches the driver until the clusters are few
enough for the matrix.

Equal heights go to a hash of the pair, so that equal gaps (grids) do not leave one merge a round.
Rows that are all nearest to one large cluster still join it one a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.assign import pairwise
from vecloom.operators.neighbors import _data, _sides
from vecloom.operators.pivots import PivotCells
from vecloom.plans.durable import materialize, materialized


def cost(square: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Ward heights from squared distances of centroids and the sizes of both sides."""
    return square * (2 * a[:, None] * b[None, :] / (a[:, None] + b[None, :]))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    x = low * np.uint64(0x9E3779B97F4A7C15) + high
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(1)).astype(np.int64)


def _compare(table: pa.Table) -> pa.Table:
    left, right = _sides(table)
    (ia, xa), (ib, xb) = _data(left), _data(right)
    na, nb = (t.column("n").to_numpy().astype(np.float64) for t in (left, right))
    found = [np.zeros((0,), np.int64)], [np.zeros((0,), np.int64)], [np.zeros(0)], [np.zeros((0,), np.int64)]
    for s in range(0, len(ia) if len(ib) else 0, 512):
        own = ia[s : s + 512]
        w = cost(pairwise(xa[s : s + 512], xb, "euclidean"), na[s : s + 512], nb)
        w[own[:, None] == ib[None, :]] = np.inf
        at = w.argmin(axis=1)
        low = w[np.arange(len(own)), at]
        for r in np.nonzero((w == low[:, None]).sum(axis=1) > 1)[0]:
            equal = np.nonzero(w[r] == low[r])[0]
            at[r] = equal[_pair_hash(own[r : r + 1], ib[equal]).argmin()]
        ok = np.isfinite(low)
        for parts, made in zip(found, (own, ib[at], low, _pair_hash(own, ib[at]))):
            parts.append(made[ok])
    return pa.table(dict(zip(("src", "dst", "cost", "tie"), map(np.concatenate, found))))


def _least(found: DataFrame) -> DataFrame:
    return found.groupBy("src").agg(F.min(F.struct("cost", "tie", "dst")).alias("e")).select("src", "e.*")


def nearest_clusters(clusters: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(src, cost, tie, dst): the cluster of lowest Ward height with each of (id, features, n)."""
    cells = PivotCells(clusters, n, "euclidean", block_rows)
    kind, columns = "src long, dst long, cost double, tie long", ["id", "features", "n"]
    home = _least(cells.groups(cells.rows, cells.at_home(cells.rows), columns).applyInArrow(_compare, kind))
    if cells.single:
        return home
    home = materialize(home, "ward-home")
    small, large = np.ones(cells.total), np.ones(cells.total)
    found = cells.rows.groupBy("cell").agg(F.min("n").alias("a"), F.max("n").alias("b")).toArrow()  # one row a cell
    at = found.column("cell").to_numpy()
    small[at], large[at] = found.column("a").to_numpy(), found.column("b").to_numpy()
    small, large = cells.lifted(small, np.minimum, np.inf), cells.lifted(large, np.maximum, 0.0)
    shared = clusters.sparkSession.sparkContext.broadcast((small, large))

    def choose(low: np.ndarray, high: np.ndarray, nodes: np.ndarray, cell: np.ndarray, size: np.ndarray, reach: np.ndarray) -> np.ndarray:
        small, large = shared.value[0][nodes], shared.value[1][nodes]
        other = nodes[None, :] != cell[:, None]
        most = np.where(other, cost(high * high, size, large), np.inf).min(axis=1)  # every other cell holds a row
        return np.isfinite(low) & other & (cost(low * low, size, small) <= np.minimum(reach, most)[:, None] * (1 + 1e-9))

    known = home.select(F.col("src").alias("id"), F.col("cost").alias("reach"))
    sought = cells.rows.join(known, "id", "left").select("id", "features", "n", "cell", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    abroad = cells.groups(cells.rows, cells.visiting(sought, choose, ("cell", "n", "reach")), columns).applyInArrow(_compare, kind)
    return _least(home.unionByName(abroad))


def _joined(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clusters after the merges; one keeps the smaller id and lies at the weighted mean."""
    into = pairs.select(F.col("dst").alias("id"), F.col("src").alias("into"))
    parts = F.sort_array(F.collect_list(F.struct("id", "n", "features")))  # one or two
    both = clusters.join(into, "id", "left").groupBy(F.coalesce("into", "id").alias("new")).agg(F.sum("n").alias("size"), parts.alias("p"))
    a, b = F.col("p")[0], F.col("p")[1]
    mean = F.zip_with(a["features"], b["features"], lambda x, y: (x * a["n"] + y * b["n"]) / F.col("size"))
    return both.select(F.col("new").alias("id"), F.when(F.size("p") == 1, a["features"]).otherwise(mean).alias("features"), F.col("size").alias("n"))


def ward_rounds(frame: DataFrame, few: int, block_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """Merges (src, dst, weight) until at most ``few`` clusters are left, and those clusters (id, features, n).

    ``src`` and ``dst`` are the smallest ids of the two sides; ``weight`` is the height.
    """
    grouped = frame.groupBy("features").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    clusters = materialized(grouped.select("id", "features", "n"), "ward")
    count = clusters.df.count()
    firsts = clusters.df.where("n > 1").select(F.col("id").alias("src"), "features")
    copies = frame.join(firsts, "features").where("id > src")
    tree = materialize(copies.select("src", F.col("id").alias("dst"), F.lit(0.0).alias("weight")), "ward-merges")
    while count > max(1, few):
        near = materialize(nearest_clusters(clusters.df, count, block_rows), "ward-nearest")
        ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        mutual = near.groupBy(*ends).agg(F.count(F.lit(1)).alias("ways"), F.min("cost").alias("cost")).where("ways = 2")
        pairs = materialize(mutual.select("src", "dst", F.sqrt("cost").alias("weight")), "ward-merges", count)
        made = pairs.count()
        if not made:  # rounding can turn equal heights into a ring; the lowest merge is always right
            lowest = near.orderBy("cost", "tie", "src").limit(1)
            pairs, made = materialize(lowest.select(*ends, F.sqrt("cost").alias("weight")), "ward-merges", 1), 1
        tree = tree.unionByName(pairs)
        following = materialized(_joined(clusters.df, pairs), "ward", count)
        clusters.drop()
        clusters, count = following, count - made
    return tree, clusters.df
