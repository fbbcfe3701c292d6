"""Structured Streaming: scoring new rows with a snapshot, and drift by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators.snapshot import ClusterSnapshot


def score_stream(stream: DataFrame, snapshot: ClusterSnapshot, **thresholds) -> DataFrame:
    """The batch plan on a stream: stateless, so any output mode and restart work."""
    return snapshot.assign_with_scores(stream, **thresholds)


def windowed_drift(stream: DataFrame, snapshot: ClusterSnapshot, time_col: str, window: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Per window and cluster: rows, mean distance and its change from the fitted mean.

    Calibrated spherical snapshots also report how concentrations and directions moved: the state of a
    window and cluster then holds the sum of its vectors, one number a dimension, from which length and
    direction of the mean follow.  State is dropped as the watermark passes.
    """
    directed = snapshot.spherical and snapshot.is_calibrated
    scored = snapshot._scored(stream, vectors="__seen") if directed else snapshot.assign_with_scores(stream)
    scored = scored.where("label IS NOT NULL").withWatermark(time_col, watermark)
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    parts = [F.sum(F.get("__seen", F.lit(i))).alias(f"__sum{i}") for i in range(snapshot.d)] if directed else []
    sums = scored.groupBy(span, "label").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), *parts)
    own = lambda values: F.element_at(F.lit([float(v) for v in values]), (F.col("label") + 1).cast("int"))
    fit = own(snapshot.fit_mean)
    gap = F.col("mean_distance") - fit
    relative = F.when(F.abs(fit) > 1e-30, gap / F.abs(fit)).otherwise(F.when(F.abs("mean_distance") <= 1e-30, 0.0).otherwise(float("nan")))
    columns = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "label", "n", "mean_distance", relative.alias("relative_drift")]
    if directed:
        total = F.array(*[f"__sum{i}" for i in range(snapshot.d)])
        centre = F.element_at(F.lit([[float(v) for v in c] for c in snapshot.centroids]), (F.col("label") + 1).cast("int"))
        length = F.sqrt(V.dot(total, total))
        r = length / F.col("n")
        now = r * (F.lit(float(snapshot.d)) - r * r) / F.greatest(1 - r * r, F.lit(1e-10))
        before = own(snapshot.kappas)
        turned = 1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), V.dot(total, centre) / length))
        columns.append(F.when(F.abs(before) > 1e-10, (now - before) / F.abs(before)).otherwise(0.0).alias("kappa_drift"))
        columns.append(F.when(r > 1e-30, turned).otherwise(1.0).alias("direction_drift"))
    return sums.select(*columns)
