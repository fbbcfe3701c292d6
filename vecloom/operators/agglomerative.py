"""Agglomerative clustering: Lance-Williams merges of a bounded matrix; single and ward linkage at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import parse_metric
from vecloom.operators.assign import pairwise
from vecloom.operators.kmeans import checked
from vecloom.operators.linked import linked_rounds
from vecloom.operators.neighbors import BLOCK_ROWS, LOCAL_EDGES, reachability_tree
from vecloom.operators.ward import cost, ward_rounds
from vecloom.plans.components import connected_components
from vecloom.plans.durable import materialize
from vecloom.plans.frames import NotFittedError, collect_matrix, feature_frame, matrix_of, validate
from vecloom.plans.stored import StoredModel

LINKAGES = ("ward", "complete", "average", "single")


class AgglomerativeClustering(StoredModel):
    """Merges the two nearest clusters until ``n_clusters`` are left.

    Up to ``max_rows`` rows the n x n distances are merged in one place.  Beyond that single linkage cuts
    the heaviest edges of a distributed spanning tree, and ward linkage merges clusters in distributed
    rounds until ``max_rows`` are left; so do complete and average linkage, whose distances between clusters
    are a distributed table of n x n numbers (merge order then follows the sorted heights, ties by id).
    """

    def __init__(self, n_clusters: int = 2, linkage: str = "ward", metric: str = "euclidean", features: str = "features", ident: str = "id", max_rows: int = 6000, block_rows: int = BLOCK_ROWS):
        checked(n_clusters=n_clusters)
        if linkage not in LINKAGES:
            raise ValueError(f"linkage is one of {LINKAGES}")
        self.metric = parse_metric(metric)
        if linkage == "ward" and self.metric != "euclidean":
            raise ValueError("ward linkage needs the euclidean metric")
        self.n_clusters, self.linkage, self.features, self.ident, self.max_rows, self.block_rows = n_clusters, linkage, features, ident, max_rows, block_rows
        self._labels: DataFrame | None = None
        self._merges: DataFrame | None = None  # (src, dst, weight), where the merges are a distributed table

    def fit(self, df: DataFrame) -> AgglomerativeClustering:
        frame = feature_frame(df, self.features, self.ident)
        n, _ = validate(frame)
        if self.n_clusters > n:
            raise ValueError(f"{self.n_clusters} clusters asked of {n} rows")
        if n <= self.max_rows:
            ids, x = collect_matrix(frame)
            labels, self._children, self._distances = merged(x, self.n_clusters, self.linkage, self.metric)
            self._labels = df.sparkSession.createDataFrame([(i, int(v)) for i, v in zip(ids, labels)], "id long, label long")
            self._merges = None
        else:
            frame = materialize(frame, "features")
            tree = self._spanning(frame, n) if self.linkage == "single" else self._ward(frame) if self.linkage == "ward" else self._linked(frame, n)
            self._cut(frame, tree)
        self.n_clusters_ = self.n_clusters
        return self

    def _spanning(self, frame: DataFrame, n: int) -> DataFrame:
        return reachability_tree(frame.withColumn("core", F.lit(0.0)), n, self.metric, self.block_rows)

    def _ward(self, frame: DataFrame) -> DataFrame:
        """Rounds on the executors down to ``max_rows`` clusters, the last merges in their matrix."""
        tree, left = ward_rounds(frame, self.max_rows, self.block_rows)
        held = left.orderBy("id").toArrow()
        _, children, heights = merged(matrix_of(held.column("features").combine_chunks()), 1, "ward", "euclidean", held.column("n").to_numpy().astype(np.float64))
        return self._finished(frame.sparkSession, tree, held.column("id").to_pylist(), children, heights)

    def _linked(self, frame: DataFrame, n: int) -> DataFrame:
        """The same for complete and average linkage."""
        found, ids, sizes, far = linked_rounds(frame, n, self.linkage, self.metric, self.max_rows, self.block_rows)
        tree = frame.sparkSession.createDataFrame(found, "src long, dst long, weight double")
        _, children, heights = merged_matrix(far, 1, self.linkage, sizes)
        return self._finished(frame.sparkSession, tree, ids.tolist(), children, heights)

    def _finished(self, spark: SparkSession, tree: DataFrame, lowest: list, children: list, heights: list) -> DataFrame:
        """Merges of rounds and those of the matrix of what they left, as one table."""
        ends = []
        for a, b in children:  # a cluster goes by its smallest id
            ends.append((lowest[a], lowest[b]))
            lowest.append(min(ends[-1]))
        last = [(min(e), max(e), h) for e, h in zip(ends, heights)]
        return materialize(tree.unionByName(spark.createDataFrame(last, "src long, dst long, weight double")), "merges")

    def _cut(self, frame: DataFrame, tree: DataFrame) -> None:
        """Labels and merges from a tree of n - 1 edges less the n_clusters - 1 heaviest."""
        dropped = tree.orderBy(F.desc("weight"), F.desc("src"), F.desc("dst")).limit(self.n_clusters - 1)
        self._merges = materialize(tree.join(dropped.select("src", "dst"), ["src", "dst"], "left_anti"), "kept")
        linked = connected_components(self._merges.select("src", "dst"), local_edges=LOCAL_EDGES).withColumnRenamed("node", "id")
        member = frame.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        roots = {r["component"]: k for k, r in enumerate(member.select("component").distinct().orderBy("component").collect())}  # n_clusters rows
        numbers = frame.sparkSession.createDataFrame(list(roots.items()), "component long, label long")
        self._labels = materialize(member.join(numbers, "component").select("id", "label"), "labels")
        self._children = self._distances = None

    def _in_order(self) -> None:
        """The merges of a distributed fit as lists, on request."""
        if self._labels is None:
            raise NotFittedError("AgglomerativeClustering is not fitted")
        if self._children is None:
            edges = self._merges.orderBy("weight", "src", "dst").toArrow()
            ids = np.sort(self._labels.select("id").toArrow().column("id").to_numpy())
            ends = [np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("src", "dst")]
            self._children, self._distances = merge_numbers(len(ids), *ends), edges.column("weight").to_pylist()

    @property
    def children_(self) -> list[tuple[int, int]]:
        self._in_order()
        return self._children

    @property
    def distances_(self) -> list[float]:
        self._in_order()
        return self._distances

    def heights(self, spark: SparkSession) -> DataFrame:
        """(distance): the heights of all merges, as a table at every size."""
        if self._merges is not None:
            return self._merges.select(F.col("weight").alias("distance"))
        return spark.createDataFrame([(float(h),) for h in self.distances_], "distance double")

    _saved = ("n_clusters", "linkage", "metric", "features", "ident", "max_rows", "block_rows", "n_clusters_")

    def _tables(self) -> dict[str, DataFrame]:
        if self._labels is None:
            return {}
        if self._merges is not None:
            return {"labels": self._labels, "edges": self._merges}
        left, right = np.array(self._children, np.int64).reshape(-1, 2).T
        merges = pa.table({"step": np.arange(len(left)), "left": left, "right": right, "distance": np.array(self._distances, np.float64)})
        return {"labels": self._labels, "merges": self._labels.sparkSession.createDataFrame(merges)}

    def _restore(self, tables: dict[str, DataFrame]) -> None:
        self._labels, self._merges = tables.get("labels"), tables.get("edges")
        self._children = self._distances = None
        if "merges" in tables:
            merges = tables["merges"].orderBy("step").toArrow()
            self._children = list(zip(merges.column("left").to_pylist(), merges.column("right").to_pylist()))
            self._distances = merges.column("distance").to_pylist()

    @property
    def labels_(self) -> DataFrame:
        if self._labels is None:
            raise NotFittedError("AgglomerativeClustering is not fitted")
        return self._labels

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).labels_

    def __repr__(self):
        return f"AgglomerativeClustering(n_clusters={self.n_clusters}, linkage={self.linkage!r}, metric={self.metric!r})"


def merge_numbers(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The clusters each edge of a spanning tree joins, in the order given: rows are 0 .. n-1, the
    cluster made by merge k is n + k; the one that holds the lowest row comes first, as in ``merged``."""
    root, name, found = list(range(n)), list(range(n)), []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        a, b = min(a, b), max(a, b)
        found.append((name[a], name[b]))
        root[b], name[a] = a, n + k
    return found


def merged(x: np.ndarray, n_clusters: int, linkage: str, metric: str, size: np.ndarray | None = None):
    """Labels, (left, right) cluster numbers and heights of the n - n_clusters merges.

    With ``size`` the rows are themselves centroids of so many rows each (ward).
    """
    far = pairwise(x, x, metric)
    if linkage != "ward" and metric == "euclidean":
        far = np.sqrt(far)
    size = np.ones(len(x)) if size is None else size
    return merged_matrix(cost(far, size, size) if linkage == "ward" else far, n_clusters, linkage, size)


def merged_matrix(far: np.ndarray, n_clusters: int, linkage: str, size: np.ndarray):
    """The same from distances between clusters of ``size`` rows (for ward: squared heights).

    Each cluster remembers its nearest partner of higher number, so a step scans n numbers and only
    clusters whose partner changed look again.  Ward works on squared distances and reports roots.
    """
    n = len(far)
    far = (far + far.T) / 2
    np.fill_diagonal(far, np.inf)
    size, name = size.copy(), list(range(n))
    alive = np.ones(n, bool)
    slot = np.arange(n)
    partner, gap = np.zeros(n, np.int64), np.full(n, np.inf)

    def look(i):
        if i + 1 < n:
            row = np.where(alive[i + 1 :], far[i, i + 1 :], np.inf)
            k = int(row.argmin())
            partner[i], gap[i] = i + 1 + k, row[k]
        else:
            gap[i] = np.inf

    for i in range(n):
        look(i)
    children, heights = [], []
    for step in range(n - n_clusters):
        i = int(np.argmin(np.where(alive, gap, np.inf)))
        j, d = int(partner[i]), float(gap[i])
        children.append((name[i], name[j]))
        heights.append(d**0.5 if linkage == "ward" else d)
        if linkage == "ward":
            new = ((size[i] + size) * far[i] + (size[j] + size) * far[j] - size * d) / (size[i] + size[j] + size)
        elif linkage == "complete":
            new = np.maximum(far[i], far[j])
        elif linkage == "single":
            new = np.minimum(far[i], far[j])
        else:
            new = (size[i] * far[i] + size[j] * far[j]) / (size[i] + size[j])
        alive[j] = False
        gap[j] = np.inf
        new[~alive] = np.inf
        new[i] = np.inf
        far[i], far[:, i] = new, new
        size[i] += size[j]
        slot[slot == j] = i
        name[i] = n + step
        look(i)
        for r in np.nonzero(alive[:i])[0]:
            if partner[r] in (i, j):
                look(r)
            elif far[r, i] < gap[r] or (far[r, i] == gap[r] and i < partner[r]):
                partner[r], gap[r] = i, far[r, i]
        for r in np.nonzero(alive[i + 1 : j])[0] + i + 1:
            if partner[r] == j:
                look(r)
    numbers = {s: k for k, s in enumerate(np.nonzero(alive)[0])}
    return np.array([numbers[s] for s in slot]), children, heights
