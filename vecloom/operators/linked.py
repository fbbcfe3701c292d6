"""Complete and average linkage beyond one matrix: distances between clusters as a distributed table.

Both linkages need every distance and are reducible (a merge never comes nearer to a third cluster than its
parts were), so clusters that are each other's nearest merge at once and the tree is that of one merge at
a time.  The table has one row a cluster: its distances to all others, in binary.  A round finds the
nearest of each row in a narrow pass; the reciprocal pairs - one number a cluster - are matched by the driver
and go back by broadcast; columns are combined by the Lance-Williams rule where they lie, rows of a pair
meet in one join, and the smaller table is written.  The cost is n x n numbers and as many rounds as merges
take to halve it; what is left below ``few`` clusters goes to the matrix.

Equal distances go to the pair of lowest rows.  Where rounding turns equal distances into a ring, so that no
pair is reciprocal, the lowest is merged alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.assign import pairwise
from vecloom.plans.components import numbered
from vecloom.plans.durable import materialized
from vecloom.plans.frames import matrix_of

_ROW = "at long, gaps binary"


def distance_rows(frame: DataFrame, n: int, metric: str, block_rows: int) -> DataFrame:
    """(at, gaps): a row's distances to all rows in order of ``at``, for (at, features)."""
    blocks = -(-n // block_rows)
    own = F.floor(F.col("at") / block_rows).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = frame.select("at", "features", own.alias("a"), every.alias("b"), F.lit(False).alias("is_b"))
    right = frame.select("at", "features", every.alias("a"), own.alias("b"), F.lit(True).alias("is_b"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        flag = table.column("is_b").to_numpy()
        x, at = matrix_of(table.column("features").combine_chunks()), table.column("at").to_numpy()
        far = pairwise(x[~flag], x[flag], metric)
        far = np.sqrt(far) if metric == "euclidean" else far
        return pa.table({"at": at[~flag], "b": pa.array([table.column("b")[0].as_py()] * len(far), pa.int32()), "part": pa.array([row.tobytes() for row in far], pa.binary())})

    parts = left.unionByName(right).groupBy("a", "b").applyInArrow(lambda table: compare(table), "at long, b int, part binary")
    row = parts.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("b", "part"))).alias("parts"))  # n / block_rows parts
    return row.select("at", F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["part"])).alias("gaps"))


def _nearest(rows: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest other, distance) of every cluster."""

    def scan(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            to, low = np.zeros(len(at), np.int64), np.zeros(len(at))
            for k, gaps in enumerate(batch.column(1)):
                row = np.frombuffer(gaps.as_buffer()).copy()
                row[at[k]] = np.inf
                to[k] = row.argmin()  # the first of equals: with it the pair of lowest rows
                low[k] = row[to[k]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to), pa.array(low)], names=["at", "to", "low"])

    found = rows.mapInArrow(scan, "at long, to long, low double").toArrow()
    to, low = np.zeros(m, np.int64), np.zeros(m)
    at = found.column("at").to_numpy()
    to[at], low[at] = found.column("to").to_numpy(), found.column("low").to_numpy()
    return to, low


def _combined(a: np.ndarray, b: np.ndarray, na, nb, linkage: str) -> np.ndarray:
    return np.maximum(a, b) if linkage == "complete" else (na * a + nb * b) / (na + nb)


def linked_rounds(frame: DataFrame, n: int, linkage: str, metric: str, few: int, block_rows: int):
    """(merges, ids, sizes, matrix): merges (src, dst, weight) by the smallest ids of both sides, until at most
    ``few`` clusters are left, and those clusters with their distances, in order of their smallest ids."""
    placed = materialized(numbered(frame, "id", "at").select("id", "at", "features"), "placed")
    ids = placed.df.select("id", "at").toArrow().sort_by("at").column("id").to_numpy()  # one number a row
    rows = materialized(distance_rows(placed.df.select("at", "features"), n, metric, block_rows), "gaps")
    sizes, merges, spark = np.ones(n), [], frame.sparkSession
    while len(ids) > max(1, few):
        to, low = _nearest(rows.df, len(ids))
        here = np.arange(len(ids))
        a = here[(to[to] == here) & (here < to)]
        if not len(a):
            first = int(low.argmin())
            a, to = np.array([min(first, to[first])]), to.copy()
            to[a[0]] = max(first, int(to[first]))
        b = to[a]
        merges += list(zip(ids[a].tolist(), ids[b].tolist(), low[a].tolist()))
        keep = np.ones(len(ids), bool)
        keep[b] = False
        new = np.cumsum(keep) - 1
        new[b] = new[a]
        role = np.zeros(len(ids), np.int8)
        role[a], role[b] = 1, 2
        shared = spark.sparkContext.broadcast((a, b, sizes, keep, new, role))

        def columns(batches, shared=shared):
            a, b, sizes, keep, new, role = shared.value
            for batch in batches:
                at = batch.column(0).to_numpy()
                out = []
                for gaps in batch.column(1):
                    row = np.frombuffer(gaps.as_buffer()).copy()
                    row[a] = _combined(row[a], row[b], sizes[a], sizes[b], linkage)
                    out.append(row[keep].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(new[at]), pa.array(out, pa.binary()), pa.array(role[at].astype(np.int32)), pa.array(sizes[at])], names=["at", "gaps", "role", "n"])

        def pairs(batches):
            for batch in batches:
                out = [
                    _combined(np.frombuffer(x.as_buffer()), np.frombuffer(y.as_buffer()), na, nb, linkage).tobytes()
                    for x, y, na, nb in zip(batch.column(1), batch.column(2), batch.column(3).to_numpy(), batch.column(4).to_numpy())
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["at", "gaps"])

        moved = materialized(rows.df.mapInArrow(columns, f"{_ROW}, role int, n double"), "columns")
        first = moved.df.where("role = 1").select("at", F.col("gaps").alias("x"), F.col("n").alias("na"))
        second = moved.df.where("role = 2").select("at", F.col("gaps").alias("y"), F.col("n").alias("nb"))
        met = first.join(second, "at").select("at", "x", "y", "na", "nb").mapInArrow(pairs, _ROW)
        following = materialized(moved.df.where("role = 0").select("at", "gaps").unionByName(met), "gaps")
        rows.drop()
        moved.drop()
        sizes[a] += sizes[b]
        rows, ids, sizes = following, ids[keep], sizes[keep]
    held = rows.df.toArrow().sort_by("at")  # at most few x few numbers
    matrix = np.frombuffer(b"".join(held.column("gaps").to_pylist())).reshape(len(ids), -1).copy()
    for used in (rows, placed):
        used.drop()
    return merges, ids, sizes, matrix
