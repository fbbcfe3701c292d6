"""Two-level snapshots: a root snapshot and a child snapshot for each large enough root cluster."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators.embedding import EmbeddingCluster
from vecloom.operators.kmeans import load_vectors, save_vectors
from vecloom.operators.segments import fit_segments
from vecloom.operators.snapshot import ClusterSnapshot
from vecloom.plans.durable import materialized
from vecloom.plans.frames import map_matrix


class HierarchicalSnapshot:
    def __init__(self, root: ClusterSnapshot, children: dict[int, ClusterSnapshot]):
        self.root, self.children = root, dict(children)

    @property
    def k_root(self) -> int:
        return self.root.k

    @property
    def n_children(self) -> int:
        return len(self.children)

    @classmethod
    def build(cls, df: DataFrame, root_model, n_sub_clusters: int | dict[int, int] = 5, ident: str = "id", **fit) -> HierarchicalSnapshot:
        """Children are embedding clusters without reduction, fitted on the rows of each root cluster;
        ``fit`` goes to them (random_state and the like).  Clusters with fewer than twice the wanted rows
        get half as many centres as rows, those too small (under 4 rows or 2 centres) no child.

        The rows are routed once and written in order of their root cluster.  All children are fitted
        together (``operators/segments.py``): one job a round, however many there are, with the centres that
        fits one by one give.  Mini-batches and given starts are fitted one after another.
        """
        root = root_model.snapshot()
        label = "__root"
        routed = root.assign(df.select(F.col(ident).alias("id"), F.col(root.features).alias(root.features))).withColumnRenamed("label", label)
        table = materialized(routed.sortWithinPartitions(label), "routed")
        sizes = {r[label]: r["count"] for r in table.df.groupBy(label).count().collect()}
        wanted = {}
        for j in range(root.k):
            n = sizes.get(j, 0)
            k = n_sub_clusters.get(j, 5) if isinstance(n_sub_clusters, dict) else n_sub_clusters
            if n < 2 * k:
                k = max(1, n // 2)
            if k >= 2 and n >= 4:
                wanted[j] = EmbeddingCluster(k, reduction_dim=None, features=root.features, ident="id", **fit)
        if all(c.algorithm != "minibatch" and isinstance(c.init, str) and c.init == "k-means++" for c in wanted.values()):
            children = fit_segments(table.df, label, wanted)
        else:
            children = {j: c.fit(table.df.where(F.col(label) == j).drop(label)).snapshot() for j, c in wanted.items()}
        table.drop()
        return cls(root, children)

    def scored(self, x: np.ndarray, thresholds: dict) -> list[np.ndarray]:
        """root label, confidence, rejected; child label, confidence, rejected; rejected by either."""
        label, _, _, confidence, rejected = self.root.judged(x, **thresholds)
        child, sure, gone = np.full(len(x), -1), np.zeros(len(x)), np.ones(len(x), bool)
        for j, snapshot in self.children.items():
            mine = np.nonzero((label == j) & ~rejected)[0]
            if len(mine):
                child[mine], _, _, sure[mine], gone[mine] = snapshot.judged(x[mine], **thresholds)
        return [label, confidence, rejected, child, sure, gone, rejected | gone]

    def _routed(self, df: DataFrame, thresholds: dict, rejecting: bool) -> DataFrame:
        for snapshot in (self.root, *self.children.values()):
            snapshot.check_thresholds(**thresholds)
        shared = df.sparkSession.sparkContext.broadcast((self.root, self.children))

        def compute(x):
            out = HierarchicalSnapshot(*shared.value).scored(x, thresholds)
            return out if rejecting else [out[0], out[3]]

        number, double, flag = (T.LongType(), pa.int64()), (T.DoubleType(), pa.float64()), (T.BooleanType(), pa.bool_())
        added = [("root_label", *number), ("root_confidence", *double), ("root_rejected", *flag), ("child_label", *number), ("child_confidence", *double), ("child_rejected", *flag), ("rejected", *flag)]
        return map_matrix(df, self.root.features, added if rejecting else [added[0], added[3]], compute)

    def assign(self, df: DataFrame, boundary_mode: str = "voronoi") -> DataFrame:
        """``df`` with root_label and child_label (-1 where there is no child); nothing is rejected."""
        return self._routed(df, {"boundary_mode": boundary_mode}, False)

    def assign_with_scores(self, df: DataFrame, **thresholds) -> DataFrame:
        """Root and child labels, confidences and rejections; the thresholds hold at both levels, rows the
        root rejects or without a child count as rejected by the child.

        One narrow pass: all snapshots are broadcast, rows meet the child of their root label in the batch.
        """
        return self._routed(df, thresholds, True)

    def save(self, spark: SparkSession, path: str) -> None:
        """The root's snapshot, and all children as one table partitioned by ``root_id`` (one row a vector)
        with their metadata: reading one child touches its own partition."""
        self.root.save(spark, os.path.join(path, "root"))
        rows, meta = [], {}
        for j, child in self.children.items():
            meta[j], tables = child.stored()
            rows += [(int(j), kind, i, [float(v) for v in row]) for kind, m in tables.items() if m is not None for i, row in enumerate(np.atleast_2d(m))]
        table = spark.createDataFrame(rows, "root_id long, kind string, row long, values array<double>")
        table.repartition(1, "root_id").write.mode("overwrite").partitionBy("root_id").parquet(os.path.join(path, "children"))
        save_vectors(spark, os.path.join(path, "hierarchy"), {"children": sorted(self.children), "layout": 2, "metadata": meta})

    @classmethod
    def load(cls, spark: SparkSession, path: str, only: list[int] | None = None) -> HierarchicalSnapshot:
        """What ``save`` wrote, also in the earlier form of one directory a child; ``only`` reads those children."""
        stored = load_vectors(spark, os.path.join(path, "hierarchy"))[0]
        wanted = [j for j in stored["children"] if only is None or j in only]
        root = ClusterSnapshot.load(spark, os.path.join(path, "root"))
        if stored.get("layout") != 2:
            return cls(root, {j: ClusterSnapshot.load(spark, os.path.join(path, "children", str(j))) for j in wanted})
        held: dict[int, dict] = {j: {} for j in wanted}
        if wanted:
            table = spark.read.schema("kind string, row long, values array<double>, root_id long").parquet(os.path.join(path, "children"))
            for r in table.where(F.col("root_id").isin(wanted)).orderBy("root_id", "kind", "row").collect():
                held[r["root_id"]].setdefault(r["kind"], []).append(r["values"])
        return cls(root, {j: ClusterSnapshot.restored(stored["metadata"][str(j)], {kind: np.array(m) for kind, m in held[j].items()}) for j in wanted})

    def __repr__(self):
        return f"HierarchicalSnapshot(k_root={self.k_root}, n_children={self.n_children})"
