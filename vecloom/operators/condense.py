"""Condensing a spanning tree of any size: density clusters without the tree of its rows.

A dendrogram over n rows has n - 1 merges, but a condensed one knows only the *large* components (at
least ``min_size`` rows): where two of them meet, and the edge at which each row enters its first one.
Both are found by contracting the spanning tree in rounds, as tables:

- every small component looks at its lightest edge; two that look at each other are siblings in the
  dendrogram and merge.  If they are large together, a *seed* is born, and their rows enter there.
- a small component that looks, over ever lighter edges, at a large one or at a newborn seed enters it at
  its own edge, however long the chain; all chains of a round are followed at once, by doubling.
- others wait.  Only reciprocal pairs grow, so there are at most about ``min_size`` rounds, usually far fewer;
  as soon as few edges (counted) touch small components, these are contracted in one place.

What remains is one edge fewer than there are seeds - at most n / min_size - and is exactly the tree over
seeds whose merges join large components.  That cluster tree (some 40 bytes a seed) is the only thing the
driver sees; rows find their cluster in a narrow map, climbing from their seed to the last merge before
the edge at which they entered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.plans.components import numbered
from vecloom.plans.durable import materialize, materialized

HUGE = float(np.finfo(float).max)


def density_of(weight: np.ndarray) -> np.ndarray:
    return np.where(weight > 0, 1 / np.where(weight > 0, weight, 1.0), HUGE)


@dataclass
class Contracted:
    """``rows``: (id, seed, rank, weight) with the edge at which each row entered; ``merges``: (rank, weight,
    a, b) between seeds; ``births``: (seed, rank) - the edge at which each seed was born."""

    rows: DataFrame
    merges: DataFrame
    births: DataFrame
    heaviest: float


def contract(ids: DataFrame, tree: DataFrame, min_size: int, local_edges: int = 0) -> Contracted:
    """Contract a spanning tree (src, dst, weight) of the rows ``ids`` (id); ties by weight, src, dst.

    Needs at least ``min_size`` rows, and ``min_size`` of at least 2.
    """
    spark = ids.sparkSession
    ranked = numbered(tree.select(F.struct("weight", "src", "dst").alias("edge")), "edge", "rank")
    edges = materialized(ranked.select("rank", "edge.weight", F.col("edge.src").alias("a"), F.col("edge.dst").alias("b")), "ranked")
    first = edges.df
    heaviest = first.agg(F.max("weight").alias("w")).first()["w"]
    small = materialized(ids.select("id", F.col("id").alias("c")), "waiting")
    sizes = materialized(ids.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("n")), "sizes")  # of small components
    entered: list[DataFrame] = []
    births: list[DataFrame] = []
    while not small.df.isEmpty():
        near = F.greatest(*[F.coalesce(F.col(f"n{end}"), F.lit(0)) for end in "ab"]) > 0
        sized = edges.df
        for end in ("a", "b"):
            sized = sized.join(sizes.df.select(F.col("c").alias(end), F.col("n").alias(f"n{end}")), end, "left")
        if local_edges and edges.df.count() <= 64 * local_edges:  # else most edges are still small
            open_edges = materialized(sized.where(near).select("rank", "weight", "a", "b", "na", "nb"), "open")
            if open_edges.df.count() <= local_edges:
                settled, born, joined = _contract_here(open_edges.df.toArrow(), min_size)
                settled = materialize(spark.createDataFrame(settled), "settled")
                births.append(spark.createDataFrame(born))
                entered.append(small.df.join(settled, "c").select("id", "seed", "rank"))
                rest = sized.where(~near).select("rank", "weight", "a", "b")
                edges = materialized(rest.unionByName(spark.createDataFrame(joined)), "ranked")
                break
            open_edges.drop()
        ends = edges.df.select("a", "b", "rank").unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank"))
        lightest = ends.groupBy(F.col("a").alias("c")).agg(F.min(F.struct("rank", F.col("b").alias("to"))).alias("pick"))
        looks = materialize(sizes.df.join(lightest, "c").select("c", "n", "pick.rank", "pick.to"), "looks")
        # two that look at each other name the same edge; the one of lower number stands for both
        other = looks.select(F.col("c").alias("to"), F.col("rank").alias("their_rank"), F.col("n").alias("m"))
        pair = F.coalesce(F.col("rank") == F.col("their_rank"), F.lit(False))
        looks = materialize(looks.join(other, "to", "left").select("c", "n", "rank", "to", pair.alias("pair"), F.when(pair, F.col("n") + F.col("m")).alias("both")), "looks")
        heads = looks.where(F.col("pair") & (F.col("c") < F.col("to")))
        born, grown = heads.where(F.col("both") >= min_size), heads.where(F.col("both") < min_size)
        ended = _chain_ends(looks)
        # what a chain ends in: a large component (which looks at nothing), a newborn one, or a pair still small
        kinds = looks.select(F.col("c").alias("end"), (F.col("pair") & (F.col("both") >= min_size)).alias("newborn"))
        enters = ended.df.join(kinds, "end", "left").where(F.coalesce("newborn", F.lit(True))).select("c", F.col("end").alias("now"), "rank")
        enters = enters.unionByName(born.select("c", F.col("c").alias("now"), "rank"))
        moved = materialized(enters.unionByName(grown.select(F.col("to").alias("c"), F.col("c").alias("now"), F.lit(None).cast("long").alias("rank"))), "moved")

        births.append(born.select(F.col("c").alias("seed"), "rank"))
        settled = moved.df.where("rank IS NOT NULL")
        now = materialize(small.df.join(moved.df, "c", "left").select("id", F.coalesce("now", "c").alias("c"), "rank"), "placed")
        entered.append(now.where("rank IS NOT NULL").select("id", F.col("c").alias("seed"), "rank"))
        waiting = materialized(now.where("rank IS NULL").select("id", "c"), "waiting")
        left = sizes.df.join(settled.select("c"), "c", "left_anti").join(grown.select(F.col("to").alias("c")), "c", "left_anti")
        left = materialized(left.join(grown.select("c", "both"), "c", "left").select("c", F.coalesce("both", "n").alias("n")), "sizes")
        renamed = edges.df
        for end in ("a", "b"):
            renamed = renamed.join(moved.df.select(F.col("c").alias(end), "now"), end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
        renamed = materialized(renamed.where("a <> b").select("rank", "weight", "a", "b"), "ranked")
        for used in (small, sizes, ended, moved, *([] if edges.df is first else [edges])):
            used.drop()
        small, sizes, edges = waiting, left, renamed
    every, born = entered[0], births[0]
    for e, b in zip(entered[1:], births[1:]):
        every, born = every.unionByName(e), born.unionByName(b)
    weights = first.select("rank", "weight")
    return Contracted(materialize(every.join(weights, "rank").select("id", "seed", "rank", "weight"), "entries"), edges.df, born, heaviest)


def _chain_ends(looks: DataFrame):
    """(c, rank, end): where each look leads in the end, by doubling.  The lower of a pair is an end, and so
    is what looks at nothing; ends themselves are left out."""
    to = F.when(F.col("pair") & (F.col("c") > F.col("to")), F.col("to")).when(~F.col("pair"), F.col("to"))
    steps = materialized(looks.select("c", "rank", to.alias("end")).where("end IS NOT NULL"), "steps")
    while True:
        further = steps.df.select(F.col("c").alias("end"), F.col("end").alias("beyond"))
        doubled = materialized(steps.df.join(further, "end", "left").select("c", "rank", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNotNull().alias("moved")), "steps")
        steps.drop()
        if doubled.df.where("moved").isEmpty():
            return doubled
        steps = doubled


def _contract_here(edges: pa.Table, min_size: int) -> tuple[pa.Table, pa.Table, pa.Table]:
    """(c, seed, rank) of small components, (seed, rank) of births and the edges left between large ones,
    for a counted number of edges; ``na`` and ``nb`` are the sizes of small ends, null at large ones."""
    edges = edges.sort_by("rank")
    rank, weight, a, b = (edges.column(c).to_numpy() for c in ("rank", "weight", "a", "b"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)].tolist(), at[len(a) :].tolist()
    size = [min_size] * len(names)
    for ends, column in ((a, "na"), (b, "nb")):
        for v, n in zip(ends, edges.column(column).to_pylist()):
            if n is not None:
                size[v] = n
    seed = [v if n >= min_size else -1 for v, n in enumerate(size)]
    top, members = list(range(len(names))), [[v] if seed[v] < 0 else [] for v in range(len(names))]
    settled, born, left = [], [], []

    def root(v):
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    for k, (u, v) in enumerate(zip(a, b)):
        x, y = root(u), root(v)
        if size[x] >= min_size and size[y] >= min_size:
            left.append((k, seed[u], seed[v]))
        elif size[x] + size[y] >= min_size:
            small, large = (x, y) if size[x] < size[y] else (y, x)
            if size[large] < min_size:
                seed[large] = min(members[large] + members[small])
                born.append((k, seed[large]))
                for c in members[large]:
                    settled.append((c, seed[large], k))
                    seed[c] = seed[large]
                name = seed[large]
            else:
                name = seed[u] if seed[u] >= 0 else seed[v]
            for c in members[small]:
                settled.append((c, name, k))
                seed[c] = name
            members[x], members[y] = [], []
        else:
            members[x] = members[x] + members[y]
            members[y] = []
        top[y] = x
        size[x] += size[y]
    pick = lambda rows, j, kind=np.int64: np.array([r[j] for r in rows], kind)
    return (
        pa.table({"c": names[pick(settled, 0)], "seed": names[pick(settled, 1)], "rank": rank[pick(settled, 2)]}),
        pa.table({"seed": names[pick(born, 1)], "rank": rank[pick(born, 0)]}),
        pa.table({"rank": rank[pick(left, 0)], "weight": weight[pick(left, 0)], "a": names[pick(left, 1)], "b": names[pick(left, 2)]}),
    )


class ClusterTree:
    """The merges of large components: 2 S - 1 nodes over S seeds, each of which begins a cluster.

    ``parent``, ``jump`` (a skip pointer: any ancestor is reached in a logarithmic number of steps) and
    ``rank`` (the edge of a node's own merge, -1 for seeds); the root is its own parent.
    """

    def __init__(self, seeds: np.ndarray, ranks: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(ranks)
        self.seeds = np.sort(seeds)
        count = len(seeds)
        total = 2 * count - 1
        self.parent = np.arange(total)
        self.rank = np.concatenate([np.full(count, -1, np.int64), ranks[order]])
        self.weight = np.concatenate([np.zeros(count), weights[order]])
        top = list(range(total))  # a shortcut towards the node that holds a seed by now
        parent = list(range(total))
        for new, (u, v) in enumerate(zip(np.searchsorted(self.seeds, a[order]).tolist(), np.searchsorted(self.seeds, b[order]).tolist()), count):
            for end in (u, v):
                path = []
                while top[end] != end:
                    path.append(end)
                    end = top[end]
                for p in path:
                    top[p] = new
                parent[end] = top[end] = new
        jump, depth = list(range(total)), [0] * total
        for v in range(total - 2, -1, -1):  # parents have higher numbers
            p = parent[v]
            depth[v] = depth[p] + 1
            far = jump[p]
            jump[v] = jump[far] if depth[p] - depth[far] == depth[far] - depth[jump[far]] else p
        self.parent, self.jump = np.array(parent, np.int64), np.array(jump, np.int64)

    def clusters(self, seed: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The node that holds each seed just before the edge ``rank``."""
        at = np.searchsorted(self.seeds, seed)
        while True:
            up = self.parent[at]
            go = np.nonzero((up != at) & (self.rank[up] < rank))[0]
            if not len(go):
                return at
            far = self.jump[at[go]]
            at[go] = np.where(self.rank[far] < rank[go], far, up[go])


def selected(stability: np.ndarray, above: np.ndarray, inner: np.ndarray, method: str) -> np.ndarray:
    """The selected cluster that holds each cluster, -1 where none does; a cluster has a smaller number than
    the one above it.  ``eom``: the larger of its own stability and the best below it; ``leaf``: leaves."""
    count = len(stability)
    best, below, keeps = stability.copy(), np.zeros(count), ~inner
    for c in range(count):
        if inner[c] and method == "eom":
            keeps[c] = stability[c] >= below[c]
            best[c] = stability[c] if keeps[c] else below[c]
        if above[c] >= 0:
            below[above[c]] = float(below[above[c]]) + float(best[c])  # may become infinite
    chosen = np.full(count, -1)
    for c in range(count - 1, -1, -1):
        over = chosen[above[c]] if above[c] >= 0 else -1
        chosen[c] = over if over >= 0 else c if keeps[c] else -1
    return chosen


def condensed_frame(ids: DataFrame, tree: DataFrame, min_size: int, method: str, compat: bool, local_edges: int = 0) -> tuple[DataFrame, list[float]]:
    """(id, label, probability) and the stabilities of the selected clusters, as ``condensed_labels`` gives
    them for a tree in one place."""
    spark = ids.sparkSession
    small = contract(ids, tree, min_size, local_edges)
    seeds = small.births.toArrow().column("seed").to_numpy()
    merges = small.merges.toArrow()
    nodes = ClusterTree(seeds, *(merges.column(c).to_numpy() for c in ("rank", "weight", "a", "b")))
    shared = spark.sparkContext.broadcast(nodes)

    def place(batches):
        for b in batches:
            seed, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            cluster = shared.value.clusters(seed, rank)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), pa.array(rank), pa.array(density_of(b.column(3).to_numpy()))], names=["id", "cluster", "rank", "density"])

    kind = small.rows.schema["id"].dataType.simpleString()
    placed = materialize(small.rows.select("id", "seed", "rank", "weight").mapInArrow(place, f"id {kind}, cluster long, rank long, density double"), "placed")

    count = len(nodes.parent)
    root = count - 1
    birth = density_of(nodes.weight[nodes.parent])
    birth[root] = density_of(np.array([small.heaviest]))[0]
    born = spark.sparkContext.broadcast(birth)

    def gains(batches):
        for b in batches:
            cluster, density = b.column(0).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(density), pa.array(np.clip(density - born.value[cluster], 0, None))], names=["cluster", "rank", "density", "gain"])

    sums = placed.select("cluster", "rank", "density").mapInArrow(gains, "cluster long, rank long, density double, gain double")
    sums = sums.groupBy("cluster").agg(F.sum("gain").alias("gain"), F.max("density").alias("last"), F.max("rank").alias("rank")).toArrow()  # at most one row a node
    held = sums.column("cluster").to_numpy()
    stability, death, head = np.zeros(count), birth.copy(), nodes.rank.copy()
    stability[held] = np.minimum(sums.column("gain").to_numpy(), HUGE)
    death[held] = np.maximum(death[held], sums.column("last").to_numpy())
    head[held] = np.maximum(head[held], sums.column("rank").to_numpy())
    # clusters are numbered by the last merge inside each
    order = np.argsort(head, kind="stable")
    number = np.empty(count, np.int64)
    number[order] = np.arange(count)
    above = np.where(order == root, -1, number[nodes.parent[order]])
    inner = np.zeros(count, bool)
    inner[above[above >= 0]] = True
    birth, death, stability = birth[order], death[order], stability[order]
    death[above[above >= 0]] = birth[above >= 0]
    chosen = selected(stability, above, inner, method)
    picked = np.nonzero(chosen == np.arange(count))[0]
    label_of = np.full(count + 1, -1)
    label_of[picked] = np.arange(len(picked))
    owner = np.where(chosen == np.arange(count), chosen, -1) if compat else chosen
    final = spark.sparkContext.broadcast((number, owner, label_of, birth, death))

    def label(batches):
        for b in batches:
            number, owner, label_of, birth, death = final.value
            density = b.column(2).to_numpy()
            own = owner[number[b.column(1).to_numpy()]]
            p = np.where(own >= 0, np.clip((density - birth[own]) / np.maximum(death[own] - birth[own], 1e-15), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label_of[own]), pa.array(p)], names=["id", "label", "probability"])

    found = placed.select("id", "cluster", "density").mapInArrow(label, f"id {kind}, label long, probability double")
    return materialize(found, "hdbscan"), [float(min(s, HUGE)) if math.isfinite(s) else s for s in stability[picked]]
