"""Cluster quality: silhouettes, dispersion ratios, agreement with classes, representatives.

Rows labelled below 0 are noise and left out.  Euclidean silhouettes sum distances by (row, cluster) in sweeps
over the rows (``sweep.py``), so n x k numbers are written, never n x n; cosine ones need the clusters' sums only.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.neighbors import BLOCK_ROWS
from vecloom.operators.sweep import Swept, label_sums
from vecloom.plans.frames import matrix_of, validate


def _clustered(df: DataFrame, features: str, label: str, ident: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.col(features).cast("array<double>").alias("features"), F.col(label).cast("long").alias("label")).where("label >= 0")


def _counted(df: DataFrame) -> dict[int, int]:
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def _sizes(rows: DataFrame) -> tuple[int, dict[int, int]]:
    validate(rows)
    sizes = _counted(rows)
    return sum(sizes.values()), sizes


def _silhouette(a, b):
    wide = F.greatest(a, b)
    return F.when(wide == 0, 0.0).otherwise((b - a) / wide)


def _silhouettes(rows: DataFrame, n: int, d: int, sizes: dict[int, int]) -> DataFrame:
    """(id, label, silhouette): b - a over the larger; a is 0 in a cluster of one, so it scores 1."""
    sums = label_sums(Swept(rows, n, d, "euclidean", "label")).groupBy("id", "label", "other").agg(F.sum("total").alias("total"))
    sums = sums.join(rows.sparkSession.createDataFrame(list(sizes.items()), "other long, n long"), "other")
    own = F.col("label") == F.col("other")
    sides = sums.groupBy("id", "label").agg(
        F.coalesce(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))), F.lit(0.0)).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    return sides.select("id", "label", _silhouette(F.col("a"), F.col("b")).alias("silhouette"))


def silhouette_samples(df: DataFrame, features: str = "features", label: str = "label", ident: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, label, silhouette) by Euclidean distance; 0 everywhere with a single cluster.

    Every row meets every other (there is no shorter way for this metric), in chunks that travel to all tasks.
    ``block_rows`` is kept for callers and has no meaning any more.
    """
    rows = _clustered(df, features, label, ident)
    _, d = validate(rows)
    sizes = _counted(rows)
    if len(sizes) < 2:
        return rows.select("id", "label", F.lit(0.0).alias("silhouette"))
    return _silhouettes(rows, sum(sizes.values()), d, sizes)


def silhouette_score(df: DataFrame, features: str = "features", label: str = "label", ident: str = "id", block_rows: int = BLOCK_ROWS) -> float:
    return silhouette_samples(df, features, label, ident, block_rows).agg(F.avg("silhouette")).first()[0]


def cosine_silhouette_samples(df: DataFrame, features: str = "features", label: str = "label", ident: str = "id", sample_size: int | None = None, seed: int = 0) -> DataFrame:
    """Silhouettes by 1 - dot of unit vectors, 0 everywhere with a single cluster; with ``sample_size``
    about that many rows are evaluated, each against all others.

    Distances of a row to a whole cluster add up to n - x . (sum of the cluster), so the sums of the
    clusters (a model) are all that rows meet: one pass for the sums, one narrow pass, no pairs.
    """
    from vecloom.operators.snapshot import cluster_statistics

    rows = _clustered(df, features, label, ident)
    n, sizes = _sizes(rows)
    share = 1.0 if sample_size is None else min(1.0, sample_size / n)
    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    chosen = rows.where(unit < share)
    if len(sizes) < 2:
        return chosen.select("id", "label", F.lit(0.0).alias("silhouette"))
    stats = cluster_statistics(rows.select("label", F.col("features").alias("x")), 0, 0)
    names = np.array(sorted(stats))
    count = np.array([stats[j][0] for j in names], dtype=np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((names, count, np.array([stats[j][0] * stats[j][1] for j in names])))

    def score(batches):
        names, count, sums = shared.value
        for batch in batches:
            x, own = matrix_of(batch.column(2)), np.searchsorted(names, batch.column(1).to_numpy())
            if not len(x):
                continue
            total, at = count[None, :] - x @ sums.T, np.arange(len(x))
            inside = total[at, own] - (1 - np.einsum("ij,ij->i", x, x))  # without the row itself
            a = np.where(count[own] > 1, inside / np.maximum(count[own] - 1, 1), 0.0)
            mean = total / count[None, :]
            mean[at, own] = np.inf
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a), pa.array(mean.min(axis=1))], names=["id", "label", "a", "b"])

    kind = f"id {chosen.schema['id'].dataType.simpleString()}, label long, a double, b double"
    return chosen.select("id", "label", "features").mapInArrow(score, kind).select("id", "label", _silhouette(F.col("a"), F.col("b")).alias("silhouette"))


def cosine_silhouette(df: DataFrame, **options) -> float:
    return cosine_silhouette_samples(df, **options).agg(F.avg("silhouette")).first()[0]


def cluster_moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, float, float]]:
    """{label: (n, mean, sum of squared distances to the mean, sum of distances to the mean)}."""
    from vecloom.operators.snapshot import cluster_statistics

    stats = cluster_statistics(rows.select("label", F.col("features").alias("x")), 0, 0)
    centres = {j: s[1] for j, s in stats.items()}
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def scan(batches):
        from vecloom.plans.frames import matrix_of

        held: dict[int, float] = {}
        for b in batches:
            labels, x = b.column(0).to_numpy(zero_copy_only=False), matrix_of(b.column(1))
            for j in np.unique(labels):
                gap = x[labels == j] - shared.value[int(j)]
                held[int(j)] = held.get(int(j), 0.0) + float(np.sqrt((gap * gap).sum(1)).sum())
        yield pa.RecordBatch.from_pydict({"label": list(held), "total": list(held.values())}, schema=pa.schema([("label", pa.int64()), ("total", pa.float64())]))

    spread = rows.select("label", "features").mapInArrow(scan, "label long, total double").groupBy("label").agg(F.sum("total").alias("t"))
    totals = {r["label"]: r["t"] for r in spread.collect()}
    return {j: (s[0], s[1], float(s[2].sum()), totals[j]) for j, s in stats.items()}


def calinski_harabasz_score(df: DataFrame, features: str = "features", label: str = "label", ident: str = "id") -> float:
    """Between over within dispersion; the largest double where nothing varies within, 0 for one cluster."""
    rows = _clustered(df, features, label, ident)
    n, sizes = _sizes(rows)
    if len(sizes) < 2:
        return 0.0
    stats = cluster_moments(rows)
    k = len(sizes)
    centre = sum(s[0] * s[1] for s in stats.values()) / n
    between = sum(s[0] * float(((s[1] - centre) ** 2).sum()) for s in stats.values())
    within = sum(s[2] for s in stats.values())
    if within == 0 or n == k:
        return float(np.finfo(float).max)
    return (between / (k - 1)) / (within / (n - k))


def davies_bouldin_score(df: DataFrame, features: str = "features", label: str = "label", ident: str = "id") -> float:
    """Mean over clusters of the worst (spread + spread) / distance; 0 for fewer than two clusters."""
    rows = _clustered(df, features, label, ident)
    if rows.isEmpty() or len(_sizes(rows)[1]) < 2:
        return 0.0
    stats = cluster_moments(rows)
    labels = sorted(stats)
    spread = {j: stats[j][3] / stats[j][0] for j in labels}
    worst = []
    for i in labels:
        ratios = [(spread[i] + spread[j]) / d for j in labels if j != i and (d := float(np.linalg.norm(stats[i][1] - stats[j][1]))) > 0]
        worst.append(max(ratios, default=0.0))
    return float(np.mean(worst))


def resultant_lengths(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label, n, resultant_length): the norm of each cluster's mean vector, by dimension-wise averages."""
    rows = df.where(F.col(label) >= 0)
    per_dim = rows.select(F.col(label).cast("long").alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("dim", "x"))
    means = per_dim.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("resultant_length"))


def representatives(df: DataFrame, centroids, features: str = "features", label: str = "label", ident: str = "id") -> DataFrame:
    """(label, id, similarity): the row of each cluster with the largest dot product to its centre."""
    return intra_rows(df, centroids, features, label).groupBy("label").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(ident).alias("id"))).alias("best")).select("label", "best.id", (-F.col("best.s")).alias("similarity"))


def intra_rows(df: DataFrame, centroids, features: str = "features", label: str = "label") -> DataFrame:
    from vecloom.functions.vectors import dot

    centres = np.asarray(centroids, dtype=np.float64)
    table = F.broadcast(df.sparkSession.createDataFrame([(j, c.tolist()) for j, c in enumerate(centres)], "label long, centre array<double>"))
    rows = df.where(F.col(label) >= 0).withColumnRenamed(label, "label")
    return rows.join(table, "label").withColumn("similarity", dot(F.col(features).cast("array<double>"), F.col("centre")))


def intra_similarity(df: DataFrame, centroids, features: str = "features", label: str = "label") -> DataFrame:
    return intra_rows(df, centroids, features, label).groupBy("label").agg(F.avg("similarity").alias("intra_similarity"))


def contingency(df: DataFrame, label: str, truth: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


def purity(df: DataFrame, label: str = "label", truth: str = "truth") -> DataFrame:
    """One row: the share of rows in the largest class of their cluster."""
    best = contingency(df, label, truth).groupBy("label").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.agg((F.sum("m") / F.sum("n")).alias("purity"))


def nmi(df: DataFrame, label: str = "label", truth: str = "truth") -> DataFrame:
    """One row: 2 MI / (H + H), natural logarithms."""
    table = contingency(df, label, truth)
    total = table.agg(F.sum("n").alias("total"))
    rows = table.groupBy("label").agg(F.sum("n").alias("a"))
    columns = table.groupBy("truth").agg(F.sum("n").alias("b"))
    p = lambda c: F.col(c) / F.col("total")
    entropy = lambda side, c, name: side.join(F.broadcast(total)).agg((-F.sum(p(c) * F.log(p(c)))).alias(name))
    joint = table.join(rows, table["label"].eqNullSafe(rows["label"])).join(columns, table["truth"].eqNullSafe(columns["truth"])).join(F.broadcast(total))
    mutual = joint.agg(F.sum(p("n") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    return mutual.join(entropy(rows, "a", "hr")).join(entropy(columns, "b", "hc")).select((2 * F.col("mi") / (F.col("hr") + F.col("hc") + 1e-30)).alias("nmi"))


def ari(df: DataFrame, label: str = "label", truth: str = "truth") -> DataFrame:
    """One row: the adjusted Rand index; 1 where its largest value equals the expected one."""
    table = contingency(df, label, truth)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    joint = table.agg(pairs("n").alias("j"), F.sum("n").alias("total"))
    a = table.groupBy("label").agg(F.sum("n").alias("n")).agg(pairs("n").alias("a"))
    b = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(pairs("n").alias("b"))
    both = joint.join(a).join(b)
    expected = F.col("a") * F.col("b") / (F.col("total") * (F.col("total") - 1) / 2.0)
    largest = (F.col("a") + F.col("b")) / 2
    return both.select(F.when(largest == expected, 1.0).otherwise((F.col("j") - expected) / (largest - expected)).alias("ari"))


def label_agreement(df: DataFrame, left: str, right: str, exact_up_to: int = 10) -> float:
    """Share of rows on which two labellings agree under a one-to-one matching of labels.

    The best matching where neither side has more than ``exact_up_to`` labels, else a greedy one by
    falling counts.  Only the table of label pairs reaches the driver.
    """
    table = contingency(df, left, right).collect()
    total = max(1, sum(r["n"] for r in table))
    rows, columns = (sorted({r[c] for r in table}, key=lambda v: (v is None, str(v))) for c in ("label", "truth"))
    if max(len(rows), len(columns)) <= exact_up_to:
        count = {(r["label"], r["truth"]): r["n"] for r in table}
        best = {0: 0}  # most agreeing rows by the set of columns already used
        for row in rows:
            following = dict(best)
            for used, n in best.items():
                for k, column in enumerate(columns):
                    if not used >> k & 1:
                        now = n + count.get((row, column), 0)
                        if now > following.get(used | 1 << k, -1):
                            following[used | 1 << k] = now
            best = following
        return max(best.values()) / total
    used_l, used_r, agreed = set(), set(), 0
    for r in sorted(table, key=lambda r: (-r["n"], str(r["label"]), str(r["truth"]))):
        if r["label"] not in used_l and r["truth"] not in used_r:
            used_l.add(r["label"])
            used_r.add(r["truth"])
            agreed += r["n"]
    return agreed / total


def top_clusters(df: DataFrame, limit: int = 10, label: str = "label", truth: str = "truth") -> DataFrame:
    """The largest clusters: label, size, dominant class, purity."""
    table = contingency(df, label, truth)
    best = table.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "truth")))
    sizes = table.groupBy("label").agg(F.sum("n").alias("size"))
    dominant = best.where("rank = 1").select("label", F.col("truth").alias("dominant"), "n")
    return sizes.join(dominant, "label").select("label", "size", "dominant", (F.col("n") / F.col("size")).alias("purity")).orderBy(F.desc("size"), "label").limit(limit)


