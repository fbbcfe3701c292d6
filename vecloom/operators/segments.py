"""Spherical k-means of many disjoint segments of a table at once: one job a round for all of them.

The rows lie in blocks of one segment each, so a block meets the centres of its own segment only; every
segment is a set of restarts of the Lloyd loop (``operators/lloyd.py``) with its own rule to stop.  The work of
a round is that of one fit over the table, its jobs do not grow with the segments, and a segment that
holds most rows is spread over as many blocks as it fills.  What reaches the driver is one k x d matrix of
sums a restart and segment, and the candidates for starts; both grow with the models, not with the rows.

Draws are races over the rows' own keys, so the starts, and with them the centres, are those of a fit of
each segment by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.assign import nearest_one, normalized
from vecloom.operators.lloyd import BLOCK_BYTES, LEAST_CANDIDATES, START_ROUNDS, _PARTIAL, Partial, _packed, added, first_in, keyed, lloyd, partial_sums, plus_plus, summed
from vecloom.operators.snapshot import ClusterSnapshot, cluster_statistics
from vecloom.plans.durable import materialized
from vecloom.plans.frames import feature_frame, matrix_of, validate


class SegmentRows:
    """Rows of many segments for rounds of several restarts each; run r belongs to segment ``owner[r]``.

    ``frame`` has (id, features, segment); it should come sorted by segment within its partitions, as blocks end
    where the segment changes.
    """

    def __init__(self, frame: DataFrame, d: int):
        self.d, self.owner = d, []
        self.spark = frame.sparkSession

        def scan(batches):
            rows = max(1, BLOCK_BYTES // (8 * d))
            for batch in batches:
                x, keys, segment = normalized(matrix_of(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                if not len(x):
                    continue
                ends = [0, *(np.nonzero(np.diff(segment))[0] + 1).tolist(), len(x)]
                cuts = [(s, min(s + rows, high)) for low, high in zip(ends, ends[1:]) for s in range(low, high, rows)]
                arrays = [pa.array([int(segment[s]) for s, _ in cuts], pa.int64())]
                arrays += [pa.array([np.ascontiguousarray(m[s:e]).tobytes() for s, e in cuts], pa.binary()) for m in (x, keys)]
                yield pa.RecordBatch.from_arrays(arrays, names=["segment", "block", "keys"])

        blocks = keyed(frame).select("features", "key", F.col("segment").cast("long").alias("segment"))
        self.table = materialized(blocks.mapInArrow(scan, "segment long, block binary, keys binary"), "segments")
        self.tasks = len(self.table.df.inputFiles())

    def round(self, runs, metric, before=None) -> list[Partial | None]:
        d = self.d
        mine: dict[int, list[int]] = {}
        for r, segment in enumerate(self.owner):
            if runs[r] is not None:
                mine.setdefault(segment, []).append(r)
        shared = self.spark.sparkContext.broadcast((runs, before, mine))

        def scan(batches):
            runs, before, mine = shared.value
            held: list[Partial | None] = [None] * len(runs)
            for batch in batches:
                for segment, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own = mine[segment]
                    x = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d)
                    found = partial_sums(x, [runs[r] for r in own], metric, None if before is None else [before[r] for r in own])
                    for r, part in zip(own, found):
                        held[r] = part if held[r] is None else added([[held[r]], [part]])[0]
            yield _packed(held)

        # segments whose restarts have all settled are not read any further
        source = self.table.df.where(F.col("segment").isin(sorted(mine))).select("segment", "block")
        parts = summed(source.mapInArrow(scan, _PARTIAL), self.tasks, [0 if c is None else len(c) for c in runs], d)
        shared.unpersist()
        return parts

    def draw(self, sizes: dict[int, int], seeds: dict[int, int], known: dict[int, np.ndarray | None], metric: str) -> dict[int, np.ndarray]:
        """The first ``sizes[segment]`` rows of each segment's own race; a task hands on that many at most."""
        d, shared = self.d, self.spark.sparkContext.broadcast((sizes, seeds, known))

        def scan(batches):
            sizes, seeds, known = shared.value
            held: dict[int, tuple] = {}
            for batch in batches:
                for segment, block, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    x, size = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d), sizes[segment]
                    found = first_in(np.frombuffer(own.as_buffer(), np.int64), x, size, seeds[segment], known[segment], metric)
                    if segment in held:
                        t, keys, x = (np.concatenate(pair) for pair in zip(held[segment], found))
                        order = np.lexsort((keys, t))[:size]
                        found = t[order], keys[order], x[order]
                    held[segment] = found
            for segment, (t, keys, x) in held.items():
                arrays = [pa.array(np.full(len(t), segment)), pa.array(t), pa.array(keys), pa.array([row.tobytes() for row in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["segment", "t", "key", "row"])

        found = self.table.df.where(F.col("segment").isin(sorted(sizes))).mapInArrow(scan, "segment long, t double, key long, row binary")
        place = F.row_number().over(Window.partitionBy("segment").orderBy("t", "key"))
        limit = F.element_at(F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair]), F.col("segment").cast("int"))
        # the greatest size cuts each group before it is shuffled, the segment's own afterwards
        few = found.withColumn("place", place).where(F.col("place") <= max(sizes.values())).where(F.col("place") <= limit)
        rows: dict[int, list] = {s: [] for s in sizes}
        for r in few.orderBy("segment", "place").select("segment", "row").toArrow().to_pylist():
            rows[r["segment"]].append(r["row"])
        shared.unpersist()
        return {s: np.frombuffer(b"".join(own), np.float64).reshape(-1, d) for s, own in rows.items()}

    def starts(self, ks: dict[int, int], seeds: dict[int, list[int]], metric: str) -> dict[int, list[np.ndarray]]:
        """Scalable k-means++ in every segment at once (see ``lloyd.starts``, whose draws these are)."""
        size = {s: max(2 * k, LEAST_CANDIDATES) for s, k in ks.items()}
        known: dict[int, np.ndarray | None] = dict.fromkeys(ks)
        open_ = dict(size)
        for i in range(START_ROUNDS):
            if not open_:
                break
            drawn = self.draw(open_, {s: seeds[s][0] * 1009 + i for s in open_}, {s: known[s] for s in open_}, metric)
            for s, rows in drawn.items():
                known[s] = rows if known[s] is None else np.concatenate([known[s], rows])
            open_ = {s: n for s, n in open_.items() if len(drawn[s]) == n}
        self.owner = list(ks)
        weight = dict(zip(self.owner, self.round([known[s] for s in self.owner], metric)))
        return {s: [plus_plus(known[s], k, np.random.default_rng(seed), metric, weight[s].n) for seed in seeds[s]] for s, k in ks.items()}

    def labelled(self, centres: dict[int, np.ndarray], first: dict[int, int]) -> DataFrame:
        """(label, x) of all rows, labels counted on from ``first[segment]``."""
        d, shared = self.d, self.spark.sparkContext.broadcast((centres, first))

        def scan(batches):
            centres, first = shared.value
            for batch in batches:
                for segment, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d)
                    label = first[segment] + nearest_one(x, centres[segment], "dot")[0]
                    ends = pa.array(np.arange(0, x.size + 1, d, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(label), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["label", "x"])

        source = self.table.df.where(F.col("segment").isin(sorted(centres))).select("segment", "block")
        return source.mapInArrow(scan, "label long, x array<double>")


def fit_segments(df: DataFrame, segment: str, models: dict[int, object]) -> dict[int, ClusterSnapshot]:
    """Snapshots of the embedding clusters ``models`` (no reduction, full passes), each fitted on the rows of its segment.

    ``segment`` is an integer column; rows of other segments, or of none, take no part.  Clusters, seeds and
    restarts are each model's own, the longest run and its tolerance those of the first.
    """
    if not models:
        return {}
    first_model = next(iter(models.values()))
    held = df.where(F.col(segment).isin(sorted(models)))
    frame = feature_frame(held, first_model.features, first_model.ident)
    d = validate(frame)[1]
    both = held.select(F.col(first_model.ident).alias("id"), F.col(first_model.features).cast("array<double>").alias("features"), F.col(segment).alias("segment"))
    rows = SegmentRows(both, d)
    order = sorted(models)
    begun = rows.starts({s: models[s].n_clusters for s in order}, {s: [models[s].random_state + i for i in range(models[s].n_init)] for s in order}, "dot")
    rows.owner = [s for s in order for _ in begun[s]]
    runs = lloyd(rows, [c for s in order for c in begun[s]], "dot", first_model.max_iter, first_model.tol, spherical=True)
    centres = {}
    for s in order:
        own = [run for run, owner in zip(runs, rows.owner) if owner == s]
        centres[s] = min(enumerate(own), key=lambda run: (run[1][1], run[0]))[1][0]
    first = dict(zip(order, np.cumsum([0, *(len(centres[s]) for s in order)]).tolist()))
    stats = cluster_statistics(rows.labelled(centres, first), sum(map(len, centres.values())), d)
    rows.table.drop()
    out = {}
    for s in order:
        own = [stats.get(first[s] + j) for j in range(len(centres[s]))]
        sizes, intra = [0 if o is None else int(o[0]) for o in own], [0.0 if o is None else float(o[1] @ c) for o, c in zip(own, centres[s])]
        out[s] = ClusterSnapshot(centres[s], spherical=True, algorithm="embedding", features=models[s].features, sizes=sizes, fit_mean=intra)
    return out
