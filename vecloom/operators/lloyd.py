"""Lloyd rounds for any number of restarts at once, over a distributed frame or a small matrix.

The features are written once as blocks of numbers in binary form, each with a 64-bit key a row (the hash
of its id); a round reads them as matrices, assigns rows to the broadcast centroids and sums them by
centroid inside an Arrow map.  A partition gives back one k x d matrix of sums a restart; these are added on
the executors to a single one unless all of them together are small (``PARTIAL_BYTES``).  All restarts
share one pass over the data.  Matrices up to ``LOCAL_BYTES`` (counted first) are worked on in place with
the same kernel.

Starts and mini-batches are drawn by races: a row's key and the seed give a number, its weight divides the
logarithm of that, and the smallest finish first.  That is a weighted sample without replacement from
*all* rows in one pass, and the same one whether rows are held or distributed, however they are dealt.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators import bounds as B
from vecloom.operators.assign import nearest_one, nearest_two, normalized
from vecloom.plans.durable import materialize, materialized
from vecloom.plans.frames import LOCAL_BYTES, matrix_of

PREFETCH_BYTES = 32 << 20
PARTIAL_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
_PARTIAL = "run int, sums binary, far double, far_vector binary, moved long, measured long"
BOUNDS_FROM = 64  # centroids from which rows are anchored unless told otherwise
DOUBT = 0.2  # share of all distances above which a round asks for new anchors
START_ROUNDS = 5  # passes that draw candidates for starts
LEAST_CANDIDATES = 50  # drawn in each of them, or twice the clusters if that is more


@dataclass
class Partial:
    """What one restart's assignment adds up to."""

    n: np.ndarray  # rows of each centroid
    total: np.ndarray  # sum of the rows, k x d
    cost: np.ndarray  # sum of raw distances
    far: float  # the largest distance, and the row it belongs to
    vector: np.ndarray | None
    moved: int  # rows that had another centroid before
    measured: int = 0  # distances between rows and centroids

    def add(self, other: Partial) -> None:
        self.n, self.total, self.cost = self.n + other.n, self.total + other.total, self.cost + other.cost
        if other.far > self.far:
            self.far, self.vector = other.far, other.vector
        self.moved += other.moved
        self.measured += other.measured


def partial_sums(x: np.ndarray, runs: list[np.ndarray | None], metric: str, before: list[np.ndarray | None] | None = None, held: list | None = None, since: tuple[list, list] | None = None) -> list[Partial | None]:
    """Sums by centroid of every restart; ``before`` holds the centroids of the round before.

    ``held`` are the rows' anchors a restart, ``since`` the moves of ``runs`` and ``before`` from those.
    """
    out = []
    now, then = since or ([None] * len(runs), [None] * len(runs))
    for r, c in enumerate(runs):
        if c is None:
            out.append(None)
            continue
        mark = None if held is None else held[r]
        label, best, measured = B.labelled(x, c, metric, mark, now[r])
        k, d = c.shape
        n = np.bincount(label, minlength=k)
        if d <= 16:
            total = np.stack([np.bincount(label, weights=x[:, j], minlength=k) for j in range(d)], axis=1)
        else:
            order = np.argsort(label, kind="stable")
            ids = np.nonzero(n)[0]
            total = np.zeros((k, d))
            if len(ids):
                total[ids] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[ids])[:-1]]), axis=0)
        far, vector = -np.inf, None
        if len(x):
            at = len(best) - 1 - int(np.argmax(best[::-1])) if metric != "dot" else int(np.argmax(best))
            far, vector = float(best[at]), x[at].copy()
        old = None if before is None else before[r]
        moved = len(x)
        if old is not None:
            was, _, more = B.labelled(x, old, metric, mark, then[r])
            moved, measured = int((was != label).sum()), measured + more
        out.append(Partial(n.astype(np.float64), total, np.bincount(label, weights=best, minlength=k), far, vector, moved, measured))
    return out


def added(parts: list[list[Partial | None]]) -> list[Partial | None]:
    """Restart by restart; parts are changed."""
    first = parts[0]
    for more in parts[1:]:
        for r, own in enumerate(more):
            if own is not None and first[r] is not None:
                first[r].add(own)
            elif own is not None:
                first[r] = own
    return first


def race(keys: np.ndarray, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
    """When each row finishes: exponential times with the weights as rates; rows without weight never do."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * int(seed) + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    time_ = -np.log(((z >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
    if weight is None:
        return time_
    return np.where(weight > 0, time_ / np.where(weight > 0, weight, 1.0), np.inf)


def far_away(x: np.ndarray, known: np.ndarray | None, metric: str) -> np.ndarray | None:
    """The weight of a row in a draw: its raw distance (1 - dot for ``dot``) to the nearest known vector."""
    if known is None:
        return None
    near = nearest_one(x, known, metric)[1]
    near = np.maximum(1 + near if metric == "dot" else near, 0)
    return np.where(np.isfinite(near), near, 0.0)


def first_in(keys: np.ndarray, x: np.ndarray, size: int, seed: int, known: np.ndarray | None, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, keys, rows) of the ``size`` first of a race, in order; equal times go by key."""
    t = race(keys, seed, far_away(x, known, metric))
    if len(t) > size:
        few = np.nonzero(t <= np.partition(t, size - 1)[size - 1])[0]
        t, keys, x = t[few], keys[few], x[few]
    order = np.lexsort((keys, t))
    order = order[np.isfinite(t[order])][:size]
    return t[order], keys[order], x[order]


class _Batches:
    """Mini-batches: one race draws the batches of many rounds, as far as ``PREFETCH_BYTES`` hold them."""

    drawn: list[np.ndarray] = []

    def batch(self, size: int, seed: int) -> np.ndarray:
        if not self.drawn:
            rounds = max(1, min(32, PREFETCH_BYTES // max(1, size * self.d * 8)))
            x = self.draw(size * rounds, seed)
            self.drawn = [x[s : s + size] for s in range(0, len(x), size)]
            if len(self.drawn) > 1 and len(self.drawn[-1]) < size:
                self.drawn.pop()
        return self.drawn.pop()


def _since(runs, before, anchors, metric):
    """The moves of ``runs`` and ``before`` from the anchors, restart by restart."""
    if anchors is None:
        return None
    way = lambda c, a: None if c is None or a is None else B.moves(c, a, metric)
    return [way(c, a) for c, a in zip(runs, anchors)], [way(c, a) for c, a in zip(before or [None] * len(runs), anchors)]


class LocalRows(_Batches):
    """A matrix small enough to hold."""

    anchors: list[np.ndarray | None] | None = None
    held: list | None = None

    def __init__(self, ids: list, x: np.ndarray, keys: np.ndarray):
        self.ids, self.x, self.keys, self.n, self.d = ids, x, keys, *x.shape

    def round(self, runs, metric, before=None):
        return partial_sums(self.x, runs, metric, before, self.held, _since(runs, before, self.anchors, metric))

    def anchor(self, runs, metric) -> None:
        self.anchors = list(runs)
        self.held = [None if c is None else B.anchored(self.x, c, metric) for c in runs]

    def release(self) -> None:
        self.anchors = self.held = None

    def draw(self, size: int, seed: int, known: np.ndarray | None = None, metric: str = "euclidean") -> np.ndarray:
        return first_in(self.keys, self.x, size, seed, known, metric)[2]

    def first(self, k: int) -> np.ndarray:
        return self.x[:k]


def keyed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("key", F.xxhash64("id"))


def binary_blocks(frame: DataFrame, d: int) -> DataFrame:
    """The features as blocks of doubles in binary form, row by row, with the keys of their rows."""

    def scan(batches):
        rows = max(1, BLOCK_BYTES // (8 * d))
        for batch in batches:
            x, keys = matrix_of(batch.column(0)), batch.column(1).to_numpy()
            cuts = range(0, len(x), rows)
            blocks = [np.ascontiguousarray(x[s : s + rows]).tobytes() for s in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array([keys[s : s + rows].tobytes() for s in cuts], pa.binary())], names=["block", "keys"])

    return keyed(frame).select("features", "key").mapInArrow(scan, "block binary, keys binary")


class SparkRows(_Batches):
    """A distributed frame, written once so that every round reads the same rows."""

    anchors: list[np.ndarray | None] | None = None
    anchored = None

    def __init__(self, frame: DataFrame, n: int, d: int):
        self.frame, self.n, self.d = materialize(frame, "features"), n, d
        self.blocks = materialize(binary_blocks(self.frame, d), "blocks")

    def round(self, runs, metric, before=None):
        shared = self.frame.sparkSession.sparkContext.broadcast((runs, before, _since(runs, before, self.anchors, metric)))
        d, known = self.d, None if self.anchors is None else [a is not None for a in self.anchors]

        def scan(batches):
            runs, before, since = shared.value
            held = None
            for batch in batches:
                for at, block in enumerate(batch.column(0)):
                    x = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d)
                    marks = None if known is None else B.unpacked(batch.column(1)[at].as_buffer(), len(x), known)
                    own = partial_sums(x, runs, metric, before, marks, since)
                    held = own if held is None else added([held, own])
            yield _packed(held or [None] * len(runs))

        source = self.blocks.select("block") if known is None else self.anchored.df
        parts = summed(source.mapInArrow(scan, _PARTIAL), len(self.blocks.inputFiles()), [0 if c is None else len(c) for c in runs], d)
        shared.unpersist()
        return parts

    def anchor(self, runs, metric) -> None:
        """The blocks once more, with each row's centroid and bound beside them: one narrow pass and 8 bytes a
        row and restart.  The table before it is dropped."""
        shared, d = self.frame.sparkSession.sparkContext.broadcast(runs), self.d

        def scan(batches):
            for batch in batches:
                made = []
                for block in batch.column(0):
                    x = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d)
                    made.append(B.packed([None if c is None else B.anchored(x, c, metric) for c in shared.value]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["block", "held"])

        made = materialized(self.blocks.select("block").mapInArrow(scan, "block binary, held binary"), "anchored")
        self.release()
        self.anchors, self.anchored = list(runs), made
        shared.unpersist()

    def release(self) -> None:
        if self.anchored is not None:
            self.anchored.drop()
        self.anchors = self.anchored = None

    def draw(self, size: int, seed: int, known: np.ndarray | None = None, metric: str = "euclidean") -> np.ndarray:
        """``size`` rows by a race over all of them; a task hands on its own first ``size`` at most."""
        shared, d = self.frame.sparkSession.sparkContext.broadcast(known), self.d

        def scan(batches):
            t, keys, x = np.empty(0), np.empty(0, np.int64), np.empty((0, d))
            for batch in batches:
                for block, own in zip(batch.column(0), batch.column(1)):
                    rows = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d)
                    found = first_in(np.frombuffer(own.as_buffer(), np.int64), rows, size, seed, shared.value, metric)
                    t, keys, x = (np.concatenate(pair) for pair in zip((t, keys, x), found))
                    order = np.lexsort((keys, t))[:size]
                    t, keys, x = t[order], keys[order], x[order]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(keys), pa.array([row.tobytes() for row in x], pa.binary())], names=["t", "key", "row"])

        found = self.blocks.mapInArrow(scan, "t double, key long, row binary").orderBy("t", "key").limit(size).toArrow()
        shared.unpersist()
        return np.frombuffer(b"".join(found.column("row").to_pylist()), np.float64).reshape(-1, d)

    def first(self, k: int) -> np.ndarray:
        return matrix_of(self.frame.orderBy("id").limit(k).toArrow().column("features").combine_chunks())


def summed(partials: DataFrame, tasks: int, sizes: list[int], d: int) -> list[Partial | None]:
    """The sums of all tasks, restart by restart."""

    def add(batches):
        held = None
        for b in batches:
            for part in _unpacked(b, len(sizes), d):
                held = part if held is None else added([held, part])
        yield _packed(held or [None] * len(sizes))

    if tasks * sum(sizes) * (d + 2) * 8 > PARTIAL_BYTES:
        # the driver gets one matrix of sums a restart, whatever the number of tasks
        partials = partials.repartition(min(32, tasks)).mapInArrow(add, _PARTIAL).repartition(1).mapInArrow(add, _PARTIAL)
    return added([[None] * len(sizes), *(p for b in partials.toArrow().to_batches() for p in _unpacked(b, len(sizes), d))])


def _packed(parts: list[Partial | None]) -> pa.RecordBatch:
    rows = [(r, np.hstack([p.total, p.n[:, None], p.cost[:, None]]).tobytes(), p.far, None if p.vector is None else p.vector.tobytes(), p.moved, p.measured) for r, p in enumerate(parts) if p is not None]
    kinds = [pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], t) for k, t in enumerate(kinds)], names=["run", "sums", "far", "far_vector", "moved", "measured"])


def _unpacked(batch: pa.RecordBatch, runs: int, d: int):
    """One list over all restarts for each packed row, with nothing where a restart is elsewhere."""
    for r in batch.to_pylist():
        parts: list[Partial | None] = [None] * runs
        sums = np.frombuffer(r["sums"]).reshape(-1, d + 2)
        vector = None if r["far_vector"] is None else np.frombuffer(r["far_vector"])
        parts[r["run"]] = Partial(sums[:, d].copy(), sums[:, :d].copy(), sums[:, d + 1].copy(), r["far"], vector, r["moved"], r["measured"])
        yield parts


def rows_of(frame: DataFrame, n: int, d: int, local_bytes: int = LOCAL_BYTES):
    """Rows to iterate over: held where their counted size allows, else distributed."""
    if n * d * 8 <= local_bytes:
        table = keyed(frame).orderBy("id").toArrow()
        return LocalRows(table.column("id").to_pylist(), matrix_of(table.column("features").combine_chunks()), table.column("key").to_numpy())
    return SparkRows(frame, n, d)


def starts(rows, k: int, seeds: list[int], metric: str) -> list[np.ndarray]:
    """k centres a seed by scalable k-means++ (k-means||, Bahmani et al., 2012).

    Each of ``START_ROUNDS`` passes over *all* rows draws candidates by their distance to the nearest
    candidate so far (the first evenly); a last pass counts the rows nearest to each candidate.  The
    candidates, some 10 k, are bounded by the model alone; every restart draws its centres from them by
    weighted k-means++ on the driver.  No sample of the rows stands in for the rest.
    """
    if k > rows.n:
        raise ValueError(f"{k} clusters asked of {rows.n} rows")
    size, known = max(2 * k, LEAST_CANDIDATES), None
    for i in range(START_ROUNDS):
        drawn = rows.draw(size, seeds[0] * 1009 + i, known, metric)
        known = drawn if known is None else np.concatenate([known, drawn])
        if len(drawn) < size:
            break  # every row that lies apart from a candidate is one by now
    weight = rows.round([known], metric)[0].n
    return [plus_plus(known, k, np.random.default_rng(s), metric, weight) for s in seeds]


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, metric: str, weight: np.ndarray) -> np.ndarray:
    """Weighted k-means++: by weight first, then by weight times distance to the nearest chosen (1 - dot for
    ``dot``); where nothing lies apart from the chosen, evenly.  Of some draws (2 + ln k) the one that leaves
    the least weighted distance is taken, which spares restarts."""
    even = np.full(len(x), 1 / len(x))

    def from_row(at: int) -> np.ndarray:
        d = nearest_two(x, x[at : at + 1], metric)[1]
        return np.maximum(1 + d, 0) if metric == "dot" else np.maximum(d, 0)

    chosen = [int(rng.choice(len(x), p=weight / weight.sum() if weight.sum() > 0 else even))]
    near = from_row(chosen[0]) if k > 1 else None
    for _ in range(1, k):
        # a candidate that is nobody's nearest is a copy of another
        mass = near * np.maximum(weight, 0.0)
        if not (mass > 0).any():
            mass = near
        total = mass.sum()
        drawn = np.unique(rng.choice(len(x), size=2 + int(np.log(k)), p=mass / total if total > 0 and np.isfinite(total) else even))
        after = [np.minimum(near, from_row(int(at))) for at in drawn]
        best = int(np.argmin([(d * weight).sum() for d in after]))
        chosen.append(int(drawn[best]))
        near = after[best]
    return x[chosen].copy()


def lloyd(rows, starts: list[np.ndarray], metric: str, max_iter: int, tol: float, spherical: bool = False, log: list | None = None, bounds: bool = False, measured: list | None = None):
    """Per restart (centroids, cost of the last assignment, rounds): the assignment counted is the one
    made before the last update.  A restart stops when its largest centroid shift falls below ``tol``;
    on the sphere, when for two rounds cost, assignments (fewer than one row in 1,000 moved) and centres
    (1 - dot) have been steady.

    ``bounds`` anchors the rows after the second round and, in rounds that double, wherever more than
    ``DOUBT`` of all distances were measured (``operators/bounds.py``); labels and centroids stay the same.

    ``log`` receives (run, round, cost, relative change, share of rows that moved, shift, milliseconds),
    ``measured`` the distances measured each round, anchors included, as a share of all.
    """
    runs = [np.array(s, dtype=np.float64) for s in starts]
    active = [True] * len(runs)
    cost, rounds = [np.inf] * len(runs), [0] * len(runs)
    calm = [0] * len(runs)
    old: list[np.ndarray | None] = [None] * len(runs)
    due = 2
    for done in range(1, max_iter + 1):
        if not any(active):
            break
        began = time.perf_counter()
        found = rows.round([c if a else None for c, a in zip(runs, active)], metric, old if spherical else None)
        for r, c in enumerate(runs):
            if not active[r]:
                continue
            own, before, new = found[r], cost[r], c.copy()
            cost[r], rounds[r] = float(own.cost.sum()), rounds[r] + 1
            usable = own.n > 0
            if spherical:
                usable &= np.einsum("ij,ij->i", own.total, own.total) > 1e-30
            new[usable] = own.total[usable] if spherical else own.total[usable] / own.n[usable, None]
            if own.vector is not None:
                new[~usable] = own.vector
            if spherical:
                new = normalized(new)
                shift = float((1 - np.clip(np.einsum("ij,ij->i", new, c), -1, 1)).max())
            else:
                shift = float(max(nearest_two(new[j : j + 1], c[j : j + 1], metric)[1][0] for j in range(len(c))))
            runs[r], old[r] = new, c
            change = abs(cost[r] - before) / abs(before) if np.isfinite(before) and abs(before) > 1e-30 else float("inf")
            churn = own.moved / max(1.0, own.n.sum())
            if log is not None:
                log.append((r, rounds[r], cost[r], float(change), float(churn), shift, 1000 * (time.perf_counter() - began)))
            if spherical:
                settled = rounds[r] > 1 and change < 1e-4 and churn < 1e-3 and shift < max(tol, 1e-5)
                calm[r] = calm[r] + 1 if settled else 0
                active[r] = calm[r] < 2
            else:
                active[r] = not shift < tol
        share = sum(p.measured for p in found if p is not None) / sum(p.n.sum() * len(p.n) for p in found if p is not None)
        if bounds and done == due and done < max_iter and any(active):
            due *= 2
            if share > DOUBT:
                rows.anchor([c if a else None for c, a in zip(runs, active)], metric)
                share += 1
        if measured is not None:
            measured.append(float(share))
    if bounds:
        rows.release()
    return [(runs[r], cost[r], rounds[r]) for r in range(len(runs))]
