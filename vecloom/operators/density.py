"""DBSCAN and HDBSCAN."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import parse_metric
from vecloom.operators.assign import pairwise
from vecloom.operators.condense import condensed_frame, density_of, selected
from vecloom.operators.kmeans import checked
from vecloom.operators.neighbors import BLOCK_ROWS, LOCAL_EDGES, _data as sided, _reaching, _sides as block_sides, _within, core_distances, grown_tree, reachability_tree
from vecloom.operators.pivots import PivotCells
from vecloom.operators.sweep import Swept, counts, linked as swept_components, lowest
from vecloom.plans.components import connected_components, joined_roots, numbered
from vecloom.plans.durable import materialize
from vecloom.plans.frames import NotFittedError, collect_matrix, feature_frame, validate
from vecloom.plans.stored import StoredModel


class DBSCAN(StoredModel):
    """Density clusters: rows with at least ``min_samples`` rows (themselves included) within ``eps``.

    Equal vectors are one weighted row, as they share neighbours, density and cluster.  Neighbours are
    counted in the blocks that ``pivots.py`` leaves to compare; blocks of core rows give back spanning
    forests of their links, and blocks of border rows the lowest-numbered cluster next to them.  What is
    written is linear in the rows and the blocks they visit, never the pairs; where rows would visit many blocks
    they are compared in sweeps (``sweep.py``) that give back the same.  Clusters are numbered by
    their lowest core id; noise is -1.
    """

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean", features: str = "features", ident: str = "id", block_rows: int = BLOCK_ROWS):
        if not (isinstance(eps, (int, float)) and math.isfinite(eps) and eps > 0):
            raise ValueError("eps must be positive and finite")
        checked(min_samples=min_samples)
        self.eps, self.min_samples, self.metric, self.features, self.ident, self.block_rows = float(eps), min_samples, parse_metric(metric), features, ident, block_rows
        self._labels: DataFrame | None = None

    def fit(self, df: DataFrame) -> DBSCAN:
        frame = materialize(feature_frame(df, self.features, self.ident), "features")
        n, d = validate(frame)
        points, back = _weighted(frame, n, self.metric)
        count = points.count()
        cells = PivotCells(points, count, self.metric, self.block_rows)
        if cells.crowded(cells.rows, _reaching(cells, self.eps), ("cell",)):
            found = self._swept(cells.rows, count, d)
        else:
            found = self._visited(cells)
        self._labels = materialize(back(found), "dbscan")
        self._frame = frame
        return self

    def _swept(self, rows: DataFrame, n: int, d: int) -> DataFrame:
        """(id, label, is_core) by sweeps over all rows."""
        limit, swept = _Links(self.eps, self.metric).limit, Swept(rows, n, d, self.metric)
        dense = materialize(counts(swept, limit).select("id", (F.col("near") >= self.min_samples).alias("is_core")), "density")
        core = swept.rows.drop("chunk").join(dense.where("is_core").select("id"), "id")
        core = Swept(core, n, d, self.metric)
        inside = _core_labels(swept_components(core, limit, lambda links: connected_components(links, local_edges=LOCAL_EDGES)))
        sparse = swept.rows.join(dense.where(~F.col("is_core")).select("id"), "id")
        return _labelled(dense, inside, lowest(core, sparse, inside, limit))

    def _visited(self, cells: PivotCells) -> DataFrame:
        """The same by the blocks that the cells leave open."""
        ahead, links = _within(cells, cells.rows, self.eps), _Links(self.eps, self.metric)
        met = cells.groups(cells.rows, ahead, ["id", "features", "n"]).applyInArrow(lambda table: links.counts(table), "id long, near long")
        near = cells.rows.select("id", F.col("n").alias("near")).unionByName(met).groupBy("id").agg(F.sum("near").alias("near"))
        dense = materialize(near.select("id", (F.col("near") >= self.min_samples).alias("is_core")), "density")
        core = dense.where("is_core").select("id")
        linked = cells.groups(cells.rows.join(core, "id"), ahead.join(core, "id"), ["id", "features"]).applyInArrow(lambda table: links.forest(table), "src long, dst long")
        linked = connected_components(materialize(linked, "core-links"), local_edges=LOCAL_EDGES)
        member = materialize(core.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "member")
        inside = _core_labels(member)
        sparse = cells.rows.join(dense.where(~F.col("is_core")).select("id"), "id").withColumn("label", F.lit(None).cast("long"))
        columns = ["id", "features", "label"]
        border = cells.groups(cells.rows.join(inside, "id"), _within(cells, sparse, self.eps, both_ways=True), columns).applyInArrow(lambda table: links.lowest(table), "id long, near long")
        return _labelled(dense, inside, border.groupBy("id").agg(F.min("near").alias("near")))

    _saved = ("eps", "min_samples", "metric", "features", "ident", "block_rows")

    def _tables(self) -> dict[str, DataFrame]:
        return {} if self._labels is None else {"labels": self._labels, "vectors": self._frame}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self._labels, self._frame = tables.get("labels"), tables.get("vectors")

    def _known(self) -> DataFrame:
        if self._labels is None:
            raise NotFittedError("DBSCAN is not fitted")
        return self._labels

    @property
    def labels_(self) -> DataFrame:
        return self._known().select("id", "label")

    @property
    def core_sample_indices_(self) -> DataFrame:
        return self._known().where("is_core").select("id")

    @property
    def components_(self) -> DataFrame:
        """The vectors of the core rows."""
        return self._frame.join(self.core_sample_indices_, "id")

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).labels_

    def __repr__(self):
        return f"DBSCAN(eps={self.eps}, min_samples={self.min_samples}, metric={self.metric!r})"


def _core_labels(member: DataFrame) -> DataFrame:
    """(id, label) of core rows from (id, component): clusters in the order of their lowest core id."""
    return materialize(member.join(numbered(member.select("component").distinct(), "component", "label"), "component").select("id", "label"), "core-labels")


def _labelled(dense: DataFrame, inside: DataFrame, border: DataFrame) -> DataFrame:
    return dense.join(inside, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "near", F.lit(-1)).cast("long").alias("label"), "is_core")


def components_within(frame: DataFrame, n: int, d: int, radius: float, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, component): the smallest id that each row reaches over pairs within ``radius``; no pairs are written."""
    metric = parse_metric(metric)
    links, cells = _Links(radius, metric), PivotCells(frame.select("id", "features"), n, metric, block_rows)
    joined = lambda edges: connected_components(edges, local_edges=LOCAL_EDGES)
    if cells.crowded(cells.rows, _reaching(cells, radius), ("cell",)):
        return swept_components(Swept(cells.rows, n, d, metric), links.limit, joined)
    found = cells.groups(cells.rows, _within(cells, cells.rows, radius), ["id", "features"]).applyInArrow(lambda table: links.forest(table), "src long, dst long")
    found = joined(materialize(found, "links")).withColumnRenamed("node", "id")
    return frame.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _weighted(frame: DataFrame, n: int, metric: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(id, features, n) with one row, of the smallest id, for equal vectors, and the way back to all rows.

    Zero vectors have cosine distance 1 to each other as to all others, so they stay single.
    """
    single = F.lit(None).cast("long")
    if metric == "cosine":
        single = F.when(~F.exists("features", lambda v: v != 0), F.col("id"))
    rows = frame.withColumn("alone", single)
    points = materialize(rows.groupBy("features", "alone").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "points")
    if points.count() == n:
        return points.drop("alone"), lambda found: found

    def back(found: DataFrame) -> DataFrame:
        known = points.select(F.col("features").alias("f"), F.col("alone").alias("a"), "id").join(found, "id").drop("id")
        return rows.join(known, (F.col("features") == F.col("f")) & F.col("alone").eqNullSafe(F.col("a"))).select("id", *[c for c in found.columns if c != "id"])

    return points.drop("alone"), back


class _Links:
    """What blocks of visitors and visited rows give back about their pairs within ``eps``."""

    def __init__(self, eps: float, metric: str):
        self.limit, self.metric = eps * eps if metric == "euclidean" else eps, metric

    def _near(self, left: pa.Table, right: pa.Table):
        """(slice of visitors, mask visitors x visited), some visitors at a time."""
        (_, xa), (_, xb) = sided(left), sided(right)
        for s in range(0, len(xa), 512):
            yield slice(s, s + 512), pairwise(xa[s : s + 512], xb, self.metric) <= self.limit

    def counts(self, table: pa.Table) -> pa.Table:
        """Rows near each row; a pair inside one cell is counted once, from its lower id."""
        left, right = block_sides(table)
        ia, ha, na = (left.column(c).to_numpy() for c in ("id", "cell", "n"))
        ib, hb, nb = (right.column(c).to_numpy() for c in ("id", "cell", "n"))
        a, b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        for part, near in self._near(left, right):
            near &= (ha[part][:, None] != hb[None, :]) | (ia[part][:, None] < ib[None, :])
            a[part] += near @ nb
            b += na[part] @ near
        return pa.table({"id": np.concatenate([ia[a > 0], ib[b > 0]]), "near": np.concatenate([a[a > 0], b[b > 0]])})

    def forest(self, table: pa.Table) -> pa.Table:
        """Each linked row with the smallest row it is connected to inside the block."""
        left, right = block_sides(table)
        ids, at = np.unique(np.concatenate([left.column("id").to_numpy(), right.column("id").to_numpy()]), return_inverse=True)
        mine, other = at[: left.num_rows], at[left.num_rows :]
        root = np.arange(len(ids))
        for part, near in self._near(left, right):
            p, q = np.nonzero(near)
            root = joined_roots(root, mine[part][p], other[q])
        moved = np.nonzero(root != np.arange(len(ids)))[0]
        return pa.table({"src": ids[moved], "dst": ids[root[moved]]})

    def lowest(self, table: pa.Table) -> pa.Table:
        """The lowest label among the visited rows near each visitor."""
        left, right = block_sides(table)
        label, none = right.column("label").to_numpy(), np.iinfo(np.int64).max
        best = np.full(left.num_rows, none)
        for part, near in self._near(left, right):
            best[part] = np.where(near, label[None, :], none).min(axis=1, initial=none)
        hit = best < none
        return pa.table({"id": left.column("id").to_numpy()[hit], "near": best[hit]})


class HDBSCAN(StoredModel):
    """Hierarchical density clusters.

    Core distances, spanning tree and its condensation are distributed (``condense.py``): the driver sees the
    cluster tree alone, at most two nodes for every ``min_cluster_size`` rows.  Up to ``local_rows`` rows,
    counted first, the same is done in one place.
    ``compat`` labels only rows that fell out of a selected cluster itself, not out of its deselected
    descendants; ``compat=False`` labels those too.
    """

    def __init__(self, min_cluster_size: int = 5, min_samples: int | None = None, metric: str = "euclidean", cluster_selection_method: str = "eom", features: str = "features", ident: str = "id", compat: bool = True, local_rows: int = 4096, block_rows: int = BLOCK_ROWS):
        if not isinstance(min_cluster_size, int) or min_cluster_size < 2:
            raise ValueError("min_cluster_size must be at least 2")
        if min_samples is not None:
            checked(min_samples=min_samples)
        if cluster_selection_method not in ("eom", "leaf"):
            raise ValueError("cluster_selection_method is eom or leaf")
        self.min_cluster_size, self.min_samples, self.metric = min_cluster_size, min_samples or min_cluster_size, parse_metric(metric)
        self.cluster_selection_method, self.features, self.ident, self.compat = cluster_selection_method, features, ident, compat
        self.local_rows, self.block_rows = local_rows, block_rows
        self._labels: DataFrame | None = None

    def fit(self, df: DataFrame) -> HDBSCAN:
        frame = feature_frame(df, self.features, self.ident)
        n, d = validate(frame)
        if n <= self.local_rows:
            ids, x = collect_matrix(frame)
            labels, p, persistence = np.full(n, -1), np.zeros(n), []
            if n >= self.min_cluster_size:
                labels, p, persistence = condensed_labels(n, spanning_tree(x, self.min_samples, self.metric), self.min_cluster_size, self.cluster_selection_method, self.compat)
            self._labels = df.sparkSession.createDataFrame(pa.table({"id": pa.array(ids), "label": pa.array(labels), "probability": pa.array(p)}))
        elif n < self.min_cluster_size:
            self._labels, persistence = materialize(frame.select("id", F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("probability")), "hdbscan"), []
        else:
            frame = materialize(frame, "features")
            with_core = materialize(frame.join(core_distances(frame, n, self.min_samples, self.metric, self.block_rows), "id"), "cored")
            tree = reachability_tree(with_core, n, self.metric, self.block_rows)
            self._labels, persistence = condensed_frame(frame.select("id"), tree, self.min_cluster_size, self.cluster_selection_method, self.compat, LOCAL_EDGES)
        self.cluster_persistence_ = [float(p) for p in persistence]
        return self

    _saved = ("min_cluster_size", "min_samples", "metric", "cluster_selection_method", "features", "ident", "compat", "local_rows", "block_rows", "cluster_persistence_")

    def _tables(self) -> dict[str, DataFrame]:
        return {} if self._labels is None else {"rows": self._labels}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self._labels = tables.get("rows")

    def _known(self) -> DataFrame:
        if self._labels is None:
            raise NotFittedError("HDBSCAN is not fitted")
        return self._labels

    @property
    def labels_(self) -> DataFrame:
        return self._known().select("id", "label")

    @property
    def probabilities_(self) -> DataFrame:
        return self._known().select("id", "probability")

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).labels_

    def __repr__(self):
        return f"HDBSCAN(min_cluster_size={self.min_cluster_size}, min_samples={self.min_samples}, metric={self.metric!r})"


def spanning_tree(x: np.ndarray, k: int, metric: str) -> list[tuple[float, int, int]]:
    """(weight, a, b) edges of a minimum spanning tree of mutual reachability, growing from row 0."""
    n = len(x)
    if n < 2:
        return []
    core = np.empty(n)
    for i in range(n):
        row = pairwise(x[i : i + 1], x, metric)[0]
        row[i] = np.inf
        core[i] = np.partition(row, min(k, n - 1) - 1)[min(k, n - 1) - 1]
    return grown_tree(x, np.sqrt(core) if metric == "euclidean" else core, metric)


def single_linkage(n: int, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent of each node, other child of its parent, size, weight of each merge) of the merge tree of a
    spanning tree; nodes 0 .. n-1 are rows, n .. 2n-2 merges in order of weight; the root is its own parent."""
    total = 2 * n - 1
    parent, sibling, size, height = np.arange(total), np.arange(total), np.ones(total, np.int64), np.zeros(total)
    top = np.arange(total)  # a shortcut towards the node that holds a row by now
    for new, (w, a, b) in enumerate(sorted(edges), n):
        ends = []
        for v in (a, b):
            path = []
            while top[v] != v:
                path.append(v)
                v = top[v]
            top[path] = v
            ends.append(v)
        parent[ends] = top[ends] = new
        sibling[ends] = ends[::-1]
        size[new], height[new] = size[ends].sum(), w
    return parent, sibling, size, height


def _settled(step: np.ndarray) -> np.ndarray:
    """Where each node ends if it follows ``step`` until that stays, by doubling."""
    while True:
        further = step[step]
        if (further == step).all():
            return step
        step = further


def condensed_labels(n: int, edges, min_size: int, method: str, compat: bool):
    """Labels, probabilities and stabilities from a spanning tree (Campello, Moulavi and Sander, 2013).

    All of it is array work over the merge tree.  A node with at least ``min_size`` rows is large.  Large
    siblings each begin a cluster, other large nodes belong to that of the nearest node above that began one.
    A row leaves its cluster at the parent of the topmost small node above it.  The cluster table (birth,
    death, stability by one sum over rows) is swept once upwards for the best choice, once down to take it.
    """
    if not edges:
        return np.full(n, -1), np.zeros(n), []
    huge = float(np.finfo(float).max)
    parent, sibling, size, height = single_linkage(n, edges)
    density = density_of(height)
    nodes, root = np.arange(len(parent)), len(parent) - 1
    large = size >= min_size
    begins = large & large[sibling] & (parent != nodes)
    begins[root] = True
    home = _settled(np.where(begins, nodes, parent))
    topmost = _settled(np.where(~large & ~large[parent], parent, nodes))[:n]
    left = np.where(topmost == root, root, parent[topmost])  # the merge at which each row leaves its cluster
    heads = np.nonzero(begins)[0]
    number = np.full(len(parent), -1)
    number[heads] = np.arange(len(heads))
    row_cluster, row_density = number[home[left]], density[left]
    birth = np.where(heads == root, density[root], density[parent[heads]])
    above = np.where(heads == root, -1, number[home[parent[heads]]])
    count = len(heads)
    with np.errstate(over="ignore"):
        gain = np.clip(row_density - birth[row_cluster], 0, None)
        stability = np.minimum(np.bincount(row_cluster, weights=gain, minlength=count), huge)
    # a cluster dies where it splits in two; one that never does, with its last row
    death = birth.copy()
    np.maximum.at(death, row_cluster, row_density)
    inner = np.zeros(count, bool)
    split = above >= 0
    inner[above[split]] = True
    death[above[split]] = birth[split]
    chosen = selected(stability, above, inner, method)
    picked = np.nonzero(chosen == np.arange(count))[0]
    label_of = np.full(count + 1, -1)
    label_of[picked] = np.arange(len(picked))
    owner = np.where(chosen == np.arange(count), chosen, -1) if compat else chosen
    held = owner[row_cluster]
    labels = label_of[held]
    inside, p = held >= 0, np.zeros(n)
    own = held[inside]
    p[inside] = np.clip((row_density[inside] - birth[own]) / np.maximum(death[own] - birth[own], 1e-15), 0, 1)
    return labels, p, stability[picked].tolist()
