"""Cells around pivot rows, with bounds that tell which cells a row has to be compared with.

Rows go to the nearest of at most ``PIVOTS`` pivots in an Arrow map (the pivots travel by broadcast, at
most ``PIVOT_BYTES``).  A cell that is still larger than two blocks is split once more around pivots of its
own, up to as many again: what a split needs travels only to the groups that deal its rows, so leaves stay
near ``block_rows`` up to some 10^10 rows.  A cell remembers its least and greatest distance from its pivot
and the box round its rows: a row's distance to the pivot bounds its distances to the whole cell from below
and above, and its distance to the box bounds them from below again.  Split cells are bounded as a whole
first, and only where they stay open their leaves are looked at.

What is left is compared in groups of about ``block_rows`` rows a side: large cells, and cells that many
rows visit, are dealt into pieces by a hash.  Bounds carry the rounding error of the expanded square, so they
never drop a pair.  The cosine distance is bounded by the chord of unit vectors; vectors of length zero (at
distance 1 from all) and of vanishing length (bounded by nothing) have a cell each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.assign import CHUNK, pairwise
from vecloom.plans.components import numbered
from vecloom.plans.durable import materialize
from vecloom.plans.frames import list_array, matrix_of

PIVOTS, PIVOT_BYTES = 8192, 32 << 20
DEALT_ROWS = 20_000  # rows of one group that deals or bounds within a split cell
OPEN_CELLS, ASKED_ROWS = 8, 2000  # cells a row may be dealt to on average, and rows asked for that
VISITED_BYTES = 32 << 20  # vectors that may be written for visits in any case
TINY = 1e-150  # squared length below which a cosine may underflow
ROOT2 = 2.0**0.5


def to_geometry(value: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the metric (not squared) as the distances that the bounds are in."""
    return np.sqrt(2 * np.maximum(value, 0)) if metric == "cosine" else value


def from_geometry(value: np.ndarray, metric: str) -> np.ndarray:
    return value * value / 2 if metric == "cosine" else value


def _kinds(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows as the bounds see them, and masks of vanishing and of zero rows."""
    if metric != "cosine":
        return x, np.zeros(len(x), bool), np.zeros(len(x), bool)
    length2 = np.einsum("ij,ij->i", x, x)
    return x / np.sqrt(np.where(length2 < TINY, 1.0, length2))[:, None], (length2 < TINY) & (length2 > 0), length2 == 0


def _gaps(y: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots and, a row, what rounding can have added or taken."""
    middle = pivots.mean(axis=0)
    y, c = y - middle, pivots - middle
    if metric == "manhattan":
        return pairwise(y, c, metric), 1e-12 * len(middle) * (np.abs(y).sum(1) + np.abs(c).sum(1).max())
    y2, c2 = np.einsum("ij,ij->i", y, y), np.einsum("ij,ij->i", c, c)
    gap = np.sqrt(np.maximum(y2[:, None] + c2[None, :] - 2 * (y @ c.T), 0))
    unit = 1.0 if metric == "cosine" else 0.0
    return gap, 2 * np.sqrt((len(middle) + 4) * 1.2e-16) * (np.sqrt(y2) + np.sqrt(c2.max()) + unit)


def _reach_of(y: np.ndarray, pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distances of rows to cells, from the distances to their pivots."""
    gap, slack = _gaps(y, pivots, metric)
    low = np.maximum(np.maximum(gap - outer, inner - gap) - slack[:, None], 0)
    return low, gap + outer + slack[:, None]


def _chosen(choose: Callable, y: np.ndarray, low: np.ndarray, high: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], fixed: np.ndarray, nodes: np.ndarray, values: list, metric: str) -> np.ndarray:
    """The mask of ``choose``, asked again where boxes put a cell farther away; rows in ``fixed`` have none."""
    mask = choose(low, high, nodes, *values)
    row, cell = np.nonzero(mask & ~fixed[:, None] & (nodes >= 0)[None, :])
    step = max(1, CHUNK // max(1, y.shape[1]))
    for s in range(0, len(row), step):
        r, c = row[s : s + step], cell[s : s + step]
        if c.max() >= len(boxes[0]):  # cells of special rows have no box
            keep = c < len(boxes[0])
            r, c = r[keep], c[keep]
        out = np.maximum(np.maximum(boxes[0][c] - y[r], y[r] - boxes[1][c]), 0)
        far = out.sum(1) if metric == "manhattan" else np.sqrt(np.einsum("ij,ij->i", out, out))
        low[r, c] = np.maximum(low[r, c], far * (1 - 1e-12 * y.shape[1]))
    return mask & choose(low, high, nodes, *values)


def _listed(mask: np.ndarray, numbers: np.ndarray) -> pa.Array:
    row, cell = np.nonzero(mask)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(mask)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers[cell].astype(np.int32)))


def _arrays(batch, names) -> list[np.ndarray]:
    columns = [batch.column(batch.schema.get_field_index(g)) for g in names]
    return [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False) for c in columns]


class PivotCells:
    """``rows``: the given columns (id, features, ...) with ``cell``.

    Nodes are numbered: top cells first (with two for special rows), then the leaves of split ones.  No row
    lies in a split node itself; ``inner`` marks those, ``parent`` gives each leaf's.
    """

    def __init__(self, frame: DataFrame, n: int, metric: str, block_rows: int):
        self.metric, self.block_rows, self.spark, self.n = metric, block_rows, frame.sparkSession, n
        self.single = n <= block_rows
        self.leaves: DataFrame | None = None
        if self.single:
            self.rows = frame.withColumn("cell", F.lit(0))
            return
        wanted = -(-4 * n // block_rows)
        first = matrix_of(frame.select("features").limit(1).toArrow().column(0).combine_chunks())
        self.most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * first.shape[1])))
        chosen = frame.select("features").orderBy(F.xxhash64("id", F.lit(17)), "id").limit(max(1, min(self.most, wanted))).toArrow()
        picked, loose, zero = _kinds(matrix_of(chosen.column(0).combine_chunks()), metric)
        picked = np.unique(picked[~(loose | zero)], axis=0)
        self.pivots = picked if len(picked) else np.zeros((1, first.shape[1]))
        self.total = len(self.pivots) + 2
        shared = self.spark.sparkContext.broadcast(self.pivots)

        def deal(x: np.ndarray) -> tuple:
            y, loose, zero = _kinds(x, metric)
            gap, slack = _gaps(y, shared.value, metric)
            cell = gap.argmin(axis=1)
            near = gap[np.arange(len(x)), cell]
            k = len(shared.value)
            cell = np.where(loose, k, np.where(zero, k + 1, cell)).astype(np.int32)
            return pa.array(cell), pa.array(near - slack), pa.array(near + slack)

        top = materialize(self._map(frame, deal, "top int, top_low double, top_high double"), "cells")
        counts = {r["top"]: r["n"] for r in top.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a top cell
        crowded = {c: m for c, m in counts.items() if m > 2 * block_rows and c < len(self.pivots)}
        self.measured = top.withColumns({"cell": F.col("top"), "gap_low": F.col("top_low"), "gap_high": F.col("top_high")})
        if crowded:
            self.measured = self._split(top, crowded)
        self.rows = self.measured.drop("top", "top_low", "top_high", "gap_low", "gap_high")
        self._measure(self.measured)

    def _split(self, top: DataFrame, crowded: dict[int, int]) -> DataFrame:
        """The rows with leaves of the crowded cells around pivots drawn from each by a hash."""
        metric, k = self.metric, len(self.pivots) + 2
        plan = [(c, min(1.0, min(self.most, -(-4 * m // self.block_rows)) / m), -(-m // DEALT_ROWS)) for c, m in crowded.items()]
        plan = F.broadcast(self.spark.createDataFrame(plan, "top int, share double, pieces int"))  # at most PIVOTS rows
        unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(19)), 11) / F.lit(float(1 << 53))
        inside = top.join(plan, "top")
        drawn = inside.where(unit < F.col("share")).select("top", "pieces", "features", F.struct("top", F.xxhash64("id"), "id").alias("at"))
        drawn = numbered(drawn, "at", "place").select("top", "pieces", "features", (F.col("place") + k).cast("int").alias("number"))
        self.leaves = materialize(drawn, "leaf-pivots")
        self.total = k + self.leaves.count()
        to_pieces = self.leaves.select("top", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "features", "number")
        rows = inside.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(23)), F.col("pieces")).cast("int")).drop("share", "pieces")
        columns = top.columns
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in top.schema) + ", cell int, gap_low double, gap_high double"

        def deal(table: pa.Table, around: pa.Table) -> pa.Table:
            kept = [table.column(c) for c in columns]
            if not around.num_rows:  # no pivot was drawn: the cell stays whole
                return pa.table([*kept, table.column("top"), table.column("top_low"), table.column("top_high")], names=[*columns, "cell", "gap_low", "gap_high"])
            around = around.sort_by("number")
            pivots = _kinds(matrix_of(around.column("features").combine_chunks()), metric)[0]
            numbers = around.column("number").to_numpy().astype(np.int32)
            x = matrix_of(table.column("features").combine_chunks())
            cell, low, high = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
            step = max(1, CHUNK // len(pivots))
            for s in range(0, len(x), step):
                gap, slack = _gaps(_kinds(x[s : s + step], metric)[0], pivots, metric)
                at = gap.argmin(axis=1)
                near = gap[np.arange(len(at)), at]
                cell[s : s + step], low[s : s + step], high[s : s + step] = numbers[at], near - slack, near + slack
            return pa.table([*kept, pa.array(cell), pa.array(low), pa.array(high)], names=[*columns, "cell", "gap_low", "gap_high"])

        dealt = rows.groupBy("top", "piece").cogroup(to_pieces.groupBy("top", "piece")).applyInArrow(deal, schema)
        whole = top.join(plan.select("top"), "top", "left_anti").withColumns({"cell": F.col("top"), "gap_low": F.col("top_low"), "gap_high": F.col("top_high")})
        return materialize(dealt.unionByName(whole), "leaves")

    def keep_copies(self, copies: int) -> DataFrame:
        """The rows to search: of equal vectors the ``copies`` of smallest id.  The bounds follow them."""
        if self.single:
            return self.rows
        order = Window.partitionBy("features").orderBy("id")
        index = materialize(self.measured.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= copies).drop("nth"), "searched")
        self._measure(index)
        return index

    def _summaries(self, rows: DataFrame, node: str, low: str, high: str) -> DataFrame:
        """(node, n, low, high, least, most): counts, distance ranges and boxes of the nodes that hold rows."""
        metric, kind = self.metric, "node int, n long, low double, high double, least array<double>, most array<double>"

        def added(at, n, low, high, least, most) -> pa.Table:
            order = np.argsort(at, kind="stable")
            begin = np.nonzero(np.concatenate([[True], np.diff(at[order]) != 0]))[0] if len(at) else np.zeros(0, np.int64)
            fold = lambda f, values: f.reduceat(values[order], begin, axis=0)
            return pa.table({"node": at[order][begin].astype(np.int32), "n": fold(np.add, n), "low": fold(np.minimum, low), "high": fold(np.maximum, high), "least": list_array(fold(np.minimum, least)), "most": list_array(fold(np.maximum, most))})

        def scan(batches):
            for b in batches:
                if b.num_rows:
                    y = _kinds(matrix_of(b.column(0)), metric)[0]
                    yield from added(b.column(1).to_numpy(), np.ones(len(y), np.int64), b.column(2).to_numpy(), b.column(3).to_numpy(), y, y).to_batches()

        def combine(table: pa.Table) -> pa.Table:
            least, most = (matrix_of(table.column(c).combine_chunks()) for c in ("least", "most"))
            return added(*_arrays(table, ("node", "n", "low", "high")), least, most)

        return rows.select("features", node, low, high).mapInArrow(scan, kind).groupBy("node").applyInArrow(lambda table: combine(table), kind)

    def _measure(self, rows: DataFrame) -> None:
        """Bounds of top cells (broadcast) and of leaves (a table); a count a node."""
        k = len(self.pivots) + 2
        found = self._summaries(rows, "top", "top_low", "top_high").toArrow()  # at most PIVOTS + 2 rows
        at = found.column("node").to_numpy()
        inner_radius, outer_radius = np.zeros(k), np.zeros(k)
        least, most = np.zeros_like(self.pivots), np.zeros_like(self.pivots)
        inner_radius[at], outer_radius[at] = found.column("low").to_numpy(), found.column("high").to_numpy()
        plain = at < k - 2
        for box, name in ((least, "least"), (most, "most")):
            box[at[plain]] = matrix_of(found.column(name).combine_chunks())[plain]
        self.sizes, self.inner, self.parent = np.zeros(self.total, np.int64), np.zeros(self.total, bool), np.full(self.total, -1)
        self.sizes[at] = found.column("n").to_numpy()
        if self.leaves is not None:
            bounds = self._summaries(rows.where(F.col("cell") != F.col("top")), "cell", "gap_low", "gap_high")
            known = self.leaves.select(F.col("number").alias("node"), "top", F.col("features").alias("pivot"))
            self.nodes = materialize(known.join(bounds, "node"), "leaf-bounds")
            counted = self.nodes.select("node", "top", "n").toArrow()  # one row a leaf
            leaf, above = counted.column("node").to_numpy(), counted.column("top").to_numpy()
            self.sizes[leaf], self.parent[leaf] = counted.column("n").to_numpy(), above
            self.inner[above] = True
        held = np.nonzero((self.sizes > 0) & ~self.inner)[0]
        self.counts = self.spark.createDataFrame(pa.table({"to": pa.array(held.astype(np.int32)), "held": pa.array(self.sizes[held])}))
        self.shared = self.spark.sparkContext.broadcast((self.pivots, inner_radius, outer_radius, self.sizes[:k] > 0, least, most, self.inner))

    def lifted(self, values: np.ndarray, combine: np.ufunc, start) -> np.ndarray:
        """One value a node, given one a leaf: split cells combine those of their leaves."""
        out = values.copy()
        out[self.inner] = start
        leaf = np.nonzero((self.parent >= 0) & (self.sizes > 0))[0]
        combine.at(out, self.parent[leaf], values[leaf])
        return out

    def _map(self, frame: DataFrame, compute: Callable, added: str, given: tuple[str, ...] = ()) -> DataFrame:
        """``frame`` with the columns ``compute`` makes from the features and the ``given`` columns."""
        kept = [c.dataType.simpleString() for c in frame.schema]
        schema = ", ".join(f"{n} {k}" for n, k in zip(frame.columns, kept)) + ", " + added
        names = [*frame.columns, *[a.split()[0] for a in added.split(", ")]]
        step = 1 if self.single else max(1, CHUNK // (len(self.pivots) + 2))

        def scan(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, step):
                    part = batch.slice(s, step)
                    x = matrix_of(part.column(part.schema.get_field_index("features")))
                    yield pa.RecordBatch.from_arrays([*part.columns, *compute(x, *_arrays(part, given))], names=names)

        return frame.mapInArrow(scan, schema)

    def bounds(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function for tasks: least and greatest distance of each row to the rows of each top cell."""
        shared, metric = self.shared, self.metric

        def compute(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pivots, inner, outer, present, *_ = shared.value
            k = len(pivots)
            y, loose, zero = _kinds(x, metric)
            low, high = np.zeros((len(x), k + 2)), np.full((len(x), k + 2), 2.0)
            low[:, :k], high[:, :k] = _reach_of(y, pivots, inner[:k], outer[:k], metric)
            low[loose], high[loose] = 0, 2
            low[zero], high[zero] = ROOT2 - 1e-7, ROOT2 + 1e-7
            low[:, k + 1], high[:, k + 1] = ROOT2 - 1e-7, ROOT2 + 1e-7
            low[:, ~present], high[:, ~present] = np.inf, np.inf
            return low, high

        return compute

    def crowded(self, rows: DataFrame, choose: Callable, given: tuple[str, ...] = ()) -> bool:
        """Whether rows would visit more than ``OPEN_CELLS`` cells on average, as some of them tell: what they
        visit would be written so many times.  Only the way the rows are compared depends on it (``sweep.py``)."""
        if self.single or 8 * self.n * self.pivots.shape[1] * self.total <= VISITED_BYTES:
            return False
        bounds, shared, metric = self.bounds(), self.shared, self.metric
        top = len(self.pivots) + 2
        leaves = np.maximum(np.bincount(self.parent[self.parent >= 0], minlength=top)[:top], 1)

        def compute(x: np.ndarray, *values: np.ndarray) -> tuple:
            *_, least, most, _ = shared.value
            y, loose, zero = _kinds(x, metric)
            low, high = bounds(x)
            mask = _chosen(choose, y, low, high, (least, most), loose | zero, np.arange(top), values, metric) & np.isfinite(low)
            return (pa.array((mask @ leaves).astype(np.int64)),)

        asked = rows.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(max(1, self.n // ASKED_ROWS))) == 0)
        seen = self._map(asked.select("id", "features", *given), compute, "open long", given).agg(F.avg("open").alias("open")).first()["open"]
        return (seen or 0) > OPEN_CELLS

    def at_home(self, rows: DataFrame) -> DataFrame:
        """``rows`` to be compared with their own cell."""
        return rows.withColumn("targets", F.array("cell"))

    def visiting(self, rows: DataFrame, choose: Callable, given: tuple[str, ...] = ()) -> DataFrame:
        """``rows`` with leaves to compare each with (a row may come several times, with other leaves).

        ``choose(low, high, nodes, *given)`` gives the mask of rows x nodes that stay open: for split nodes,
        whether any leaf may.
        """
        bounds, shared, metric = self.bounds(), self.shared, self.metric

        def compute(x: np.ndarray, *values: np.ndarray) -> tuple:
            *_, least, most, inner = shared.value
            y, loose, zero = _kinds(x, metric)
            low, high = bounds(x)
            nodes = np.arange(low.shape[1])
            mask = _chosen(choose, y, low, high, (least, most), loose | zero, nodes, values, metric) & np.isfinite(low)
            leaf = ~inner[: len(nodes)]
            return _listed(mask & leaf, nodes), _listed(mask & ~leaf, nodes)

        seen = materialize(self._map(rows, compute, "targets array<int>, inside array<int>", given), "visits")
        if self.leaves is None:
            return seen.drop("inside")
        entering = seen.drop("targets").withColumn("to", F.explode("inside")).drop("inside")
        pieces = materialize(entering.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / DEALT_ROWS).cast("int").alias("pieces")), "entered")
        entering = entering.join(pieces, "to").withColumn("piece", F.pmod(F.xxhash64("id", F.lit(29)), F.col("pieces")).cast("int")).drop("pieces")
        below = self.nodes.join(pieces, self.nodes["top"] == pieces["to"]).drop("top").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        columns = rows.columns
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", targets array<int>"

        def look(table: pa.Table, leaves: pa.Table) -> pa.Table:
            leaves = leaves.sort_by("node")
            pivots = _kinds(matrix_of(leaves.column("pivot").combine_chunks()), metric)[0]
            nodes, inner, outer = _arrays(leaves, ("node", "low", "high"))
            boxes = tuple(matrix_of(leaves.column(c).combine_chunks()) for c in ("least", "most"))
            x = matrix_of(table.column("features").combine_chunks())
            values = _arrays(table, given)
            step, found = max(1, CHUNK // len(pivots)), []
            for s in range(0, len(x), step):
                part = slice(s, s + step)
                y, loose, zero = _kinds(x[part], metric)
                low, high = _reach_of(y, pivots, inner, outer, metric)
                low[loose], high[loose] = 0, 2
                low[zero], high[zero] = ROOT2 - 1e-7, ROOT2 + 1e-7
                found.append(_listed(_chosen(choose, y, low, high, boxes, loose | zero, nodes, [v[part] for v in values], metric), nodes))
            kept = [table.column(c) for c in columns]
            return pa.table([*kept, pa.concat_arrays(found)], names=[*columns, "targets"])

        deeper = entering.groupBy("to", "piece").cogroup(below.groupBy("to", "piece")).applyInArrow(look, schema)
        return materialize(seen.drop("inside").unionByName(deeper), "visits")

    def groups(self, index: DataFrame, visits: DataFrame, columns: list[str]):
        """Bounded groups of rows with ``is_b`` false (visitors) and true (rows of the visited cell)."""
        if self.single:
            dealt = F.broadcast(self.spark.createDataFrame([(0, 1, 1)], "to int, ci int, cp int"))
        else:
            seen = visits.select(F.explode("targets").alias("to")).groupBy("to").agg(F.count(F.lit(1)).alias("n"))
            pieces = lambda count: F.ceil(F.col(count) / self.block_rows).cast("int")
            dealt = materialize(seen.join(self.counts, "to").select("to", pieces("held").alias("ci"), pieces("n").alias("cp")), "dealt")
        piece = lambda count: F.pmod(F.xxhash64("id", F.lit(13)), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        probe = visits.select(*columns, "cell", F.explode("targets").alias("to")).join(dealt, "to")
        probe = probe.select(*columns, "cell", "to", piece("cp").alias("bp"), every("ci").alias("bi"), F.lit(False).alias("is_b"))
        found = index.select(*columns, "cell", F.col("cell").alias("to")).join(dealt, "to")
        found = found.select(*columns, "cell", "to", every("cp").alias("bp"), piece("ci").alias("bi"), F.lit(True).alias("is_b"))
        return probe.unionByName(found).groupBy("to", "bi", "bp")
