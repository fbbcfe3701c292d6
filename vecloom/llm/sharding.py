"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in source blocks.  How many rows of a block go to a shard under a uniformly random
permutation is multivariate hypergeometric; the matrix of these counts is drawn first (its rows sum
to the block sizes, its columns to the shard sizes).  Then each block is permuted on its own and cut
by its row of the matrix, the pieces are exchanged, and each shard is permuted again.  The result is
a uniform shuffle whose shard sizes are exact: any two differ by at most one row.

Scale: blocks are hash ranges of the whole row, so they are even whatever the sources are, a lost
executor recomputes the same block; rows are told apart by 128 bits of all their columns, maps by their
entries, and those equal in every column are interchangeable.  The
driver holds only the block sizes and the matrix (at most ``max_blocks`` x shards numbers).  Within a
shard the second permutation sorts by an independent random key cut into ranges, so no task sorts
more than about ``rows_per_task`` rows and slots stay gapless through the ranges' offsets.

Defined results: a null text has size 8 and a null crc; null ids and repeated rows are rows like any
other; fewer rows than shards leave the last shards empty; an empty table gives an empty result;
every input column is returned, and a clash with ``shard``/``slot`` raises ValueError.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.tables import free_name, quoted, row_hash
from vecloom.plans.durable import materialize

SHARDS = 24
LIBRARY_LIMIT = 10**9  # numpy draws hypergeometric numbers for urns below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good; urns of any size."""
    if draws == 0 or good == 0:
        return 0
    if good + bad < LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    return large_hypergeometric(rng, good, bad, draws)


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Inversion over 14 standard deviations round the mode, from exact ratios of neighbours."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    share = good / total
    spread = math.sqrt(max(1.0, draws * share * (1 - share) * (total - draws) / max(1, total - 1)))
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), low), high)
    first, last = max(low, mode - int(14 * spread) - 2), min(high, mode + int(14 * spread) + 2)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    cdf = np.cumsum(p)
    return first + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """blocks x shards counts: rows sum to the block sizes, columns to the shard sizes."""
    if sum(block_sizes) != sum(shard_sizes):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng = np.random.default_rng(seed)
    left = np.array(shard_sizes, dtype=np.int64)
    matrix = np.zeros((len(block_sizes), len(shard_sizes)), dtype=np.int64)
    for b, size in enumerate(block_sizes):
        draws, urn = size, int(left.sum())
        for s in range(len(left)):
            urn -= int(left[s])
            take = hypergeometric(rng, int(left[s]), urn, draws)
            matrix[b, s] = take
            draws -= take
        left -= matrix[b]
    return matrix


def shard_rows(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = 17,
    rows_per_task: int = 100_000,
    max_blocks: int = 65_536,
    row_key: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 within the shard).

    ``row_key`` names columns that tell rows apart well enough to hash; all columns by default.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError("the input already has a column named shard or slot")
    named = row_key or df.columns
    h, tie, block, u, part = (free_name(df, x) for x in ("hash", "tie", "block", "u", "range"))
    # rows that share one hash are told apart by a second, so only rows equal in every column can change places
    hashed = df.select("*", row_hash(df, named, seed).alias(h), row_hash(df, named, seed + 3).alias(tie))
    keys = hashed.select(h, tie)

    fine = materialize(keys.groupBy(F.pmod(h, F.lit(max_blocks)).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
    total = fine.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = min(max_blocks, max(128, 1 << math.ceil(math.log2(max(1, total / rows_per_task)))))
    sizes = [0] * blocks
    for row in fine.groupBy(F.pmod("cell", F.lit(blocks)).alias("block")).agg(F.sum("n").alias("n")).collect():
        sizes[row["block"]] = row["n"]
    even = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = communication_matrix(sizes, even, seed).cumsum(axis=1)
    schema = T.StructType([T.StructField(block, T.LongType()), T.StructField("cuts", T.ArrayType(T.LongType()))])
    matrix = materialize(df.sparkSession.createDataFrame([(b, c.tolist()) for b, c in enumerate(cuts)], schema), "matrix")
    ranges = max(8, math.ceil(total / shards / rows_per_task))

    def dealt(rows: DataFrame) -> DataFrame:
        """Permute each block, cut it by its row of the matrix, and draw the second random key."""
        own = rows.withColumn(block, F.pmod(F.pmod(h, F.lit(max_blocks)), F.lit(blocks)))
        within = Window.partitionBy(block).orderBy(F.xxhash64(h, F.lit(seed + 1)), h, tie)
        ranked = own.withColumn(u, F.row_number().over(within).cast("long") - 1)
        cut = ranked.join(matrix, block).withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col(u))).cast("int"))
        second = cut.drop("cuts", block).withColumn(u, F.xxhash64(h, F.lit(seed + 2)))
        return second.withColumn(part, F.pmod(F.shiftright(u, 20), F.lit(ranges)))

    # What each range of each shard holds follows from the hashes alone, so only those move for it.
    counts = dealt(keys).groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = free_name(df, "offset")
    offsets = materialize(counts.select("shard", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(offset)), "offsets")
    within = Window.partitionBy("shard", part).orderBy(u, h, tie)
    ranked = dealt(hashed).withColumn("slot", F.row_number().over(within).cast("long") - 1)
    placed = ranked.join(offsets, ["shard", part]).withColumn("slot", F.col("slot") + F.col(offset))
    return placed.select(*[F.col(quoted(c)) for c in df.columns], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The shard and slot of every document with its size and crc; only these slim rows move."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    return shard_rows(materialize(slim, "sizes"), shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
