"""Neighbour joins: pairs within a radius, k nearest, and minimum spanning trees of reachability.

Rows are dealt into cells around pivots (``pivots.py``) and compared by NumPy on the executors only with
cells that the triangle inequality leaves open, in bounded groups: neither a cross join nor an unbounded
group is ever formed.  Vectors without any structure (all distances alike) leave every cell open; they are
compared in sweeps (``sweep.py``), so that rows are not written once for every cell.  In up to three dimensions a radius join uses grid cells instead: an equi-join of each row's cell with its
neighbours' and a residual distance filter.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators.assign import pairwise
from vecloom.operators.pivots import PivotCells, from_geometry, to_geometry
from vecloom.operators.sweep import Swept, nearest, pairs
from vecloom.plans.components import connected_components
from vecloom.plans.durable import materialize, materialized
from vecloom.plans.frames import matrix_of

BLOCK_ROWS = 2048
SPANNED_BLOCKS = 8  # blocks of rows that one task spans by itself
LISTED = 16  # lightest edges that a swept row remembers
LOCAL_EDGES = 200_000  # counted edges up to which components are joined in one place


def _metric_values(raw: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(raw) if metric == "euclidean" else raw


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    flag = table.column("is_b").combine_chunks()
    return table.filter(pc.invert(flag)).sort_by("id"), table.filter(flag).sort_by("id")


def _data(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("id").to_numpy(), matrix_of(table.column("features").combine_chunks())


def range_join(frame: DataFrame, n: int, d: int, radius: float, metric: str = "euclidean", block_rows: int = BLOCK_ROWS, given: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, distance) for all pairs src < dst within ``radius`` (in the metric, not squared).

    The ``given`` columns of both rows come along as a_... (of src) and b_... (of dst).
    """
    metric = V.parse_metric(metric)
    if metric != "cosine" and d <= 3:
        return _grid_join(frame, d, radius, metric, given)
    raw = radius * radius if metric == "euclidean" else radius

    def compare(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        (ia, xa), (ib, xb) = _data(left), _data(right)
        ha, hb = (t.column("cell").to_numpy() for t in (left, right))
        out = []
        for s in range(0, len(ia), 512):
            part = slice(s, s + 512)
            dist = pairwise(xa[part], xb, metric)
            ahead = (ha[part][:, None] != hb[None, :]) | (ia[part][:, None] < ib[None, :])
            p, q = np.nonzero((dist <= raw) & ahead)
            out.append((p + s, q, dist[p, q]))
        p, q, dist = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        a, b = ia[p], ib[q]
        found = {"src": np.minimum(a, b).astype(np.int64), "dst": np.maximum(a, b).astype(np.int64), "distance": _metric_values(dist, metric)}
        sides = {c: (left.column(c).to_numpy()[p], right.column(c).to_numpy()[q]) for c in given}
        found |= {f"a_{c}": np.where(a < b, mine, theirs) for c, (mine, theirs) in sides.items()} | {f"b_{c}": np.where(a < b, theirs, mine) for c, (mine, theirs) in sides.items()}
        return pa.table(found)

    columns = ["id", "features", *given]
    cells = PivotCells(frame.select(*columns), n, metric, block_rows)
    if cells.crowded(cells.rows, _reaching(cells, radius), ("cell",)):
        return pairs(Swept(cells.rows, n, d, metric), raw, given)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = "src long, dst long, distance double" + "".join(f", {side}_{c} {kinds[c]}" for side in "ab" for c in given)
    return cells.groups(cells.rows, _within(cells, cells.rows, radius), columns).applyInArrow(compare, schema)


def _within(cells: PivotCells, rows: DataFrame, radius: float, both_ways: bool = False) -> DataFrame:
    """``rows`` with the cells that may hold rows within ``radius``; one way, only those of no lower number."""
    if cells.single:
        return cells.at_home(rows)
    return cells.visiting(rows, _reaching(cells, radius, both_ways), ("cell",))


def _reaching(cells: PivotCells, radius: float, both_ways: bool = False) -> Callable | None:
    """What tells which cells those are."""
    if cells.single:
        return None
    reach = float(to_geometry(np.array(radius), cells.metric)) * (1 + 1e-9)

    shared = cells.shared

    def choose(low: np.ndarray, high: np.ndarray, nodes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (low <= reach) & (both_ways | shared.value[-1][nodes][None, :] | (nodes[None, :] >= cell[:, None]))

    return choose


def _grid_join(frame: DataFrame, d: int, radius: float, metric: str, given: tuple[str, ...] = ()) -> DataFrame:
    """Rows look into their own grid cell and into those of the cells around it that come after it.

    Both sides are shuffled: a table that is small on disk may hold many rows, too many for a driver to hash.
    """
    cells, dims = [f"c{k}" for k in range(d)], range(d)
    value = lambda k: F.element_at("features", k + 1)
    cell = lambda k: F.floor(value(k) / F.lit(radius))
    steps = [s for s in product((-1, 0, 1), repeat=d) if s >= (0,) * d]
    step = F.explode(F.array(*[F.struct(*[F.lit(s[k]).alias(f"s{k}") for k in dims], F.lit(not any(s)).alias("own")) for s in steps]))
    index = frame.select(F.col("id").alias("there"), *[value(k).alias(f"y{k}") for k in dims], *[cell(k).alias(cells[k]) for k in dims], *[F.col(c).alias(f"y_{c}") for c in given])
    probe = frame.select(F.col("id").alias("here"), *[value(k).alias(f"x{k}") for k in dims], *[cell(k).alias(cells[k]) for k in dims], *[F.col(c).alias(f"x_{c}") for c in given], step.alias("s"))
    probe = probe.select("here", *[f"x{k}" for k in dims], *[(F.col(cells[k]) + F.col(f"s.s{k}")).alias(cells[k]) for k in dims], *[f"x_{c}" for c in given], "s.own")
    raw = F.lit(0.0)
    for k in dims:
        gap = F.col(f"x{k}") - F.col(f"y{k}")
        raw = raw + (gap * gap if metric == "euclidean" else F.abs(gap))
    near = (~F.col("own") | (F.col("here") < F.col("there"))) & (raw <= (radius * radius if metric == "euclidean" else radius))
    for c in cells:
        near = (probe[c] == index[c]) & near
    ahead = F.col("here") < F.col("there")
    sides = [F.when(ahead, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{name}_{c}") for name, a, b in (("a", "x", "y"), ("b", "y", "x")) for c in given]
    found = probe.hint("merge").join(index, near)
    return found.select(F.least("here", "there").alias("src"), F.greatest("here", "there").alias("dst"), V.to_metric(metric, raw).alias("distance"), *sides)


def knn_join(frame: DataFrame, n: int, k: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, rank, dst, distance): the k nearest others of every row, ties to the smaller id.

    Every row first meets its own cell; the k-th distance found there (or, with too few rows there, what
    the cells guarantee) tells which other cells can hold a nearer one.  Of equal vectors only the k + 1
    of smallest id can be among the k nearest of any row, so no more of them are looked through.
    """
    metric = V.parse_metric(metric)

    def compare(table: pa.Table) -> pa.Table:
        (ia, xa), (ib, xb) = map(_data, _sides(table))
        src, dst, far = [], [], []
        for s in range(0, len(ia), 512):
            dist = pairwise(xa[s : s + 512], xb, metric)
            dist[ia[s : s + 512][:, None] == ib[None, :]] = np.inf
            order = np.argsort(dist, axis=1, kind="stable")[:, :k]  # b is sorted by id, so ties keep the smaller
            rows = np.arange(len(order))[:, None]
            chosen = dist[rows, order]
            ok = np.isfinite(chosen)
            src.append(np.repeat(ia[s : s + 512], order.shape[1])[ok.ravel()])
            dst.append(ib[order][ok])
            far.append(chosen[ok])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"src": join(src, np.int64), "dst": join(dst, np.int64), "distance": _metric_values(join(far, np.float64), metric)})

    kind = "src long, dst long, distance double"
    cells = PivotCells(frame.select("id", "features"), n, metric, block_rows)
    index = cells.keep_copies(k + 1)
    found = cells.groups(index, cells.at_home(cells.rows), ["id", "features"]).applyInArrow(compare, kind)
    best = Window.partitionBy("src").orderBy("distance", "dst")
    if not cells.single:
        found = materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "near-home")
        known = found.where(F.col("rank") == k).select(F.col("src").alias("id"), F.col("distance").alias("bound"))
        bounded = cells.rows.join(known, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        counted = frame.sparkSession.sparkContext.broadcast(cells.sizes)

        def choose(low: np.ndarray, high: np.ndarray, nodes: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> np.ndarray:
            reach = to_geometry(bound, metric) * (1 + 1e-9)
            sizes = counted.value[nodes]
            for r in np.nonzero(np.isinf(bound))[0]:
                order = np.argsort(high[r])
                enough = np.nonzero(np.cumsum(sizes[order]) > k)[0]  # k others wherever the row itself is
                reach[r] = high[r][order[enough[0]]] if len(enough) else np.inf
            other = nodes[None, :] != cell[:, None]
            return np.isfinite(low) & (low <= reach[:, None]) & other

        if cells.crowded(bounded, choose, ("cell", "bound")):
            d = len(frame.select("features").first()[0])
            loose = F.col("bound") * (1 + 1e-9) + (1e-12 if metric == "cosine" else 0.0)  # products may round differently
            best = nearest(Swept(index, n, d, metric), bounded.withColumn("bound", loose), k).df
            return best.select(F.col("id").alias("src"), F.posexplode(F.arrays_zip("to", "far"))).select("src", (F.col("pos") + 1).alias("rank"), F.col("col.to").alias("dst"), F.col("col.far").alias("distance"))
        abroad = cells.groups(index, cells.visiting(bounded, choose, ("cell", "bound")), ["id", "features"]).applyInArrow(compare, kind)
        found = found.drop("rank").unionByName(abroad)
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("src", "rank", "dst", "distance")


def core_distances(frame: DataFrame, n: int, k: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, core): distance to the k-th nearest other row; the farthest there is if there are fewer."""
    near = knn_join(frame, n, k, metric, block_rows)
    core = near.groupBy(F.col("src").alias("id")).agg(F.max("distance").alias("core"))
    return frame.select("id").join(core, "id", "left").select("id", F.coalesce("core", F.lit(float("inf"))).alias("core"))


def reachability_tree(frame: DataFrame, n: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, weight): a minimum spanning tree of max(core, core, distance) over (id, features, core).

    Of equal vectors, which have the same core, one is spanned and the others hang on it by that core: no
    other edge of theirs is lighter.  The rest is spanned by Boruvka rounds: every component finds its lightest outgoing edge (ties by weight, then ids);
    components at least halve each round.  A round compares rows with their own cell, takes from that
    and from the bounds the heaviest weight each component's edge can have, and then visits only cells
    that are not wholly of the row's component and can hold an edge as light.
    """
    metric = V.parse_metric(metric)
    single = F.lit(None).cast("long")
    if metric == "cosine":  # zero vectors are at distance 1 from each other too
        single = F.when(~F.exists("features", lambda v: v != 0), F.col("id"))
    rows = frame.select("id", "features", "core", single.alias("alone"))
    points = materialize(rows.groupBy("features", "alone").agg(F.min("id").alias("id"), F.min("core").alias("core"), F.count(F.lit(1)).alias("n")), "points")
    count = points.count()
    if count == n:
        return _spanned(points.select("id", "features", "core"), n, metric, block_rows)
    kept = points.where("n > 1").select(F.col("features").alias("f"), F.col("alone").alias("a"), F.col("id").alias("src"))
    hung = rows.join(kept, (F.col("features") == F.col("f")) & F.col("alone").eqNullSafe(F.col("a"))).where("id <> src")
    hung = hung.select("src", F.col("id").alias("dst"), F.col("core").alias("weight"))
    return _spanned(points.select("id", "features", "core"), count, metric, block_rows).unionByName(hung)


def grown_tree(x: np.ndarray, core: np.ndarray, metric: str) -> list[tuple[float, int, int]]:
    """(weight, a, b) edges of a minimum spanning tree of max(core, core, distance), growing from row 0."""
    n = len(x)
    outside = np.ones(n, bool)
    reach, via = np.full(n, np.inf), np.zeros(n, np.int64)
    edges, at = [], 0
    for _ in range(n - 1):
        outside[at] = False
        w = np.maximum(np.maximum(_metric_values(pairwise(x[at : at + 1], x, metric)[0], metric), core[at]), core)
        closer = outside & (w < reach)
        reach[closer], via[closer] = w[closer], at
        at = int(np.argmin(np.where(outside, reach, np.inf)))
        edges.append((float(reach[at]), int(min(via[at], at)), int(max(via[at], at))))
    return edges


def _spanned(frame: DataFrame, n: int, metric: str, block_rows: int) -> DataFrame:
    if n <= SPANNED_BLOCKS * block_rows:
        # some hundred million distances take one task less time than the jobs of the rounds

        def grow(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids, x = _data(table)
            weight, a, b = zip(*grown_tree(x, table.column("core").to_numpy(), metric)) if len(ids) > 1 else ((), (), ())
            a, b = (ids[np.array(end, np.int64)] for end in (a, b))
            return pa.table({"src": a, "dst": b, "weight": pa.array(weight, pa.float64())})

        return materialize(frame.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(lambda table: grow(table), "src long, dst long, weight double"), "tree")
    cells = PivotCells(frame, n, metric, block_rows)

    def lightest(low: np.ndarray, high: np.ndarray, nodes: np.ndarray, core: np.ndarray) -> np.ndarray:
        return np.isfinite(low) & (from_geometry(low, metric) <= core[:, None])

    if cells.crowded(cells.rows, lightest, ("core",)):
        return _swept_tree(cells.rows, n, metric)
    labelled = materialized(cells.rows.withColumn("component", F.col("id")), "boruvka")
    tree: DataFrame | None = None
    while True:

        def compare(table: pa.Table) -> pa.Table:
            left, right = _sides(table)
            (ia, xa), (ib, xb) = _data(left), _data(right)
            ca, cb = left.column("component").to_numpy(), right.column("component").to_numpy()
            ka, kb = left.column("core").to_numpy(), right.column("core").to_numpy()
            found = []
            for s in range(0, len(ia), 512):
                part = slice(s, s + 512)
                w = np.maximum(np.maximum(_metric_values(pairwise(xa[part], xb, metric), metric), ka[part][:, None]), kb[None, :])
                w[ca[part][:, None] == cb[None, :]] = np.inf
                if not w.size:
                    continue
                # b is sorted by id, so of a row's equal edges the first has the smallest pair of ids
                near = w.argmin(axis=1)
                low = w[np.arange(len(near)), near]
                held = np.isfinite(low)
                mine, theirs = ia[part][held], ib[near[held]]
                found.append((ca[part][held], low[held], np.minimum(mine, theirs), np.maximum(mine, theirs)))
            if not found:
                return pa.table([pa.array([], k) for k in (pa.int64(), pa.float64(), pa.int64(), pa.int64())], names=["component", "weight", "src", "dst"])
            component, weight, src, dst = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((dst, src, weight, component))
            first = order[np.concatenate([[True], np.diff(component[order]) != 0])[: len(order)]]
            return pa.table({"component": component[first], "weight": weight[first], "src": src[first], "dst": dst[first]})

        kind, columns = "component long, weight double, src long, dst long", ["id", "features", "component", "core"]
        found = cells.groups(labelled.df, cells.at_home(labelled.df), columns).applyInArrow(compare, kind)
        if not cells.single:
            found = materialize(_lightest(found), "lightest-home")
            abroad = cells.groups(labelled.df, _outward(cells, labelled.df, found), columns).applyInArrow(compare, kind)
            found = found.select("component", "e.*").unionByName(abroad)
        edges = materialize(_lightest(found).select("e.src", "e.dst", "e.weight").distinct(), "lightest")
        if edges.isEmpty():
            break
        tree = edges if tree is None else tree.unionByName(edges)
        tree = materialize(tree, "tree")
        joined = connected_components(tree, local_edges=LOCAL_EDGES)
        following = materialized(
            labelled.df.drop("component").join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "features", "core", "cell", F.coalesce("component", "id").alias("component")), "boruvka"
        )
        labelled.drop()
        labelled = following
    return tree if tree is not None else frame.sparkSession.createDataFrame([], "src long, dst long, weight double")


def _swept_tree(rows: DataFrame, n: int, metric: str) -> DataFrame:
    """The same in sweeps: one lists the ``LISTED`` lightest edges of every row, and rounds take edges from the lists.

    The first listed edge out of its component is a row's lightest.  A row whose list lies in its component
    has none lighter than the last of it; only where its component has found no lighter one is the row swept again,
    for edges out of its component.  The largest component waits for the others, which all name an edge each round.
    """
    swept = Swept(rows.select("id", "features", "core", "cell"), n, len(rows.select("features").first()[0]), metric)
    every = swept.rows.select("id", "features", "core").withColumn("bound", F.lit(float("inf")))
    listed = nearest(swept, every, LISTED, weighted=True)
    number, edge = F.size("far"), F.posexplode(F.arrays_zip("far", "to"))
    ends = listed.df.select("id", edge).select("id", F.col("col.far").alias("weight"), F.least("id", "col.to").alias("src"), F.greatest("id", "col.to").alias("dst"))
    edges = materialized(ends, "listed")
    # no edge of a row that is not listed is lighter than this; none is missing where the list is not full
    last = materialized(listed.df.where(number == LISTED).select("id", F.element_at("far", -1).alias("last")), "last")
    listed.drop()
    labelled = materialized(swept.rows.select("id", F.col("id").alias("component")), "boruvka")
    tree: DataFrame | None = None
    while True:
        largest = labelled.df.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).first()["component"]
        of = lambda end: labelled.df.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
        outward = edges.df.join(of("id"), "id").withColumn("other", F.col("src") + F.col("dst") - F.col("id")).join(of("other"), "other")
        outward = materialized(outward.where("id_component <> other_component").select("id", "weight", "src", "dst", F.col("id_component").alias("component"), "other_component"), "outward")
        edges.drop()
        best = outward.df.groupBy("component").agg(F.min("weight").alias("best"))
        spent = last.df.join(outward.df.select("id"), "id", "left_anti").join(labelled.df.where(F.col("component") != largest), "id")
        spent = materialized(spent.join(best, "component", "left").where(F.col("best").isNull() | (F.col("best") >= F.col("last"))).select("id", "component"), "spent")
        named, renewed = outward.df, None
        if not spent.df.isEmpty():
            visitors = swept.rows.join(F.broadcast(spent.df) if spent.df.count() <= LOCAL_EDGES else spent.df, "id").select("id", "features", "core", "component").withColumn("bound", F.lit(float("inf")))
            known = labelled.df
            renewed = nearest(swept, visitors, LISTED, weighted=True, extra=lambda part: part.join(known, "id"))
            more = renewed.df.select("id", "component", edge).select("id", F.col("col.far").alias("weight"), F.least("id", "col.to").alias("src"), F.greatest("id", "col.to").alias("dst"), "component", F.col("col.to").alias("other"))
            named = materialize(named.unionByName(more.join(of("other"), "other").drop("other")), "named")
        chosen = named.where(F.col("component") != largest).groupBy("component").agg(F.min(F.struct("weight", "src", "dst", "other_component")).alias("e"))
        chosen = materialize(chosen.select("component", "e.*"), "lightest")
        if chosen.isEmpty():
            break
        picked = materialize(chosen.select("src", "dst", "weight").distinct(), "picked")
        tree = picked if tree is None else tree.unionByName(picked)
        joined = connected_components(chosen.select("component", "other_component"), "component", "other_component", local_edges=LOCAL_EDGES)
        moved = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
        following = materialized(labelled.df.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "boruvka")
        edges = materialized(named.select("id", "weight", "src", "dst"), "listed")
        if renewed is not None:
            fresh = renewed.df.select("id", F.when(number == LISTED, F.element_at("far", -1)).alias("last"))
            newer = materialized(last.df.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.where("last IS NOT NULL")), "last")
            last.drop()
            renewed.drop()
            last = newer
        for used in (labelled, outward, spent):
            used.drop()
        labelled = following
    return tree if tree is not None else rows.sparkSession.createDataFrame([], "src long, dst long, weight double")


def _lightest(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.min(F.struct("weight", "src", "dst")).alias("e"))


def _outward(cells: PivotCells, labelled: DataFrame, home: DataFrame) -> DataFrame:
    """The rows with the other cells that can hold an edge out of their component as light as its lightest.

    ``home`` has the lightest edges inside cells; the bounds give another limit for every component.
    """
    metric, k, top = cells.metric, cells.total, len(cells.pivots) + 2
    owner, other_owner, deepest = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min), np.zeros(k)
    found = labelled.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("core").alias("core")).toArrow()  # one row a cell
    at = found.column("cell").to_numpy()
    owner[at], other_owner[at], deepest[at] = (found.column(c).to_numpy() for c in ("a", "b", "core"))
    owner, deepest = cells.lifted(owner, np.minimum, np.iinfo(np.int64).max), cells.lifted(deepest, np.maximum, 0.0)
    mixed = owner != cells.lifted(other_owner, np.maximum, np.iinfo(np.int64).min)
    shared, bounds = labelled.sparkSession.sparkContext.broadcast((owner, mixed, deepest)), cells.bounds()

    def foreign(component: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        owner, mixed, _ = shared.value
        return mixed[nodes][None, :] | (owner[nodes][None, :] != component[:, None])

    def limit(x: np.ndarray, component: np.ndarray, core: np.ndarray) -> tuple:
        _, high = bounds(x)
        most = np.maximum(from_geometry(high, metric), np.maximum(core[:, None], shared.value[2][None, :top]))
        return (pa.array(np.where(foreign(component, np.arange(top)), most, np.inf).min(axis=1)),)

    limits = cells._map(labelled.select("features", "component", "core"), limit, "reach double", ("component", "core"))
    limits = limits.select("component", "reach").unionByName(home.select("component", F.col("e.weight").alias("reach")))
    limits = limits.groupBy("component").agg(F.min("reach").alias("reach"))

    def choose(low: np.ndarray, high: np.ndarray, nodes: np.ndarray, cell: np.ndarray, component: np.ndarray, core: np.ndarray, reach: np.ndarray) -> np.ndarray:
        least = np.maximum(from_geometry(low, metric), core[:, None])
        other = nodes[None, :] != cell[:, None]
        return np.isfinite(low) & (least <= reach[:, None] * (1 + 1e-9)) & other & foreign(component, nodes)

    return cells.visiting(labelled.join(limits, "component"), choose, ("cell", "component", "core", "reach"))
