import zlib
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import sharding as S


def test_matrix_sums_and_law():
    blocks, shards = [5, 0, 9, 1, 12], [7, 7, 7, 6]
    draws = np.array([S.communication_matrix(blocks, shards, seed) for seed in range(4000)])
    assert (draws.sum(axis=2) == blocks).all() and (draws.sum(axis=1) == shards).all() and (draws >= 0).all()
    want = np.outer(blocks, shards) / 27
    assert np.abs(draws.mean(axis=0) - want).max() < 0.1
    n, good, urn = 12, 7, 27
    variance = n * good / urn * (1 - good / urn) * (urn - n) / (urn - 1)
    assert abs(draws[:, 4, 0].var() - variance) < 0.15


def test_large_urns_follow_the_same_law():
    rng = np.random.default_rng(5)
    small = [S.large_hypergeometric(rng, 30, 50, 20) for _ in range(6000)]
    exact = rng.hypergeometric(30, 50, 20, 6000)
    assert abs(np.mean(small) - exact.mean()) < 0.12 and abs(np.var(small) - exact.var()) < 0.35
    big = [S.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 10**10) for _ in range(50)]
    spread = (10**10 * 0.4 * 0.6 * 0.9) ** 0.5
    assert abs(np.mean(big) - 4 * 10**9) < spread and 0.6 < np.std(big) / spread < 1.5
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3


def test_query(spark):
    rows = [(i, f"text é {i % 50}" if i % 7 else None, "x") for i in range(1000)] + [(None, "", "y"), (3, "dup", "y"), (3, "dup", "y")]
    out = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t, _ in rows
    )
    per = Counter(r["shard"] for r in out)
    assert len(per) == 24 and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(per[s]))
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_shuffle_is_uniform_and_repeatable(spark):
    docs = spark.createDataFrame([(i, i // 125) for i in range(3000)], "doc_id long, run int").repartition(4)
    first = {r.doc_id: (r["shard"], r.slot) for r in S.shard_rows(docs, shards=3).collect()}
    again = {r.doc_id: (r["shard"], r.slot) for r in S.shard_rows(docs.repartition(7), shards=3).collect()}
    assert first == again
    other = {r.doc_id: (r["shard"], r.slot) for r in S.shard_rows(docs, shards=3, seed=99).collect()}
    assert sum(first[i] == other[i] for i in first) < 20
    slots = np.array([first[i][1] for i in range(3000)])
    assert abs(np.corrcoef(np.arange(3000), slots)[0, 1]) < 0.07
    table = np.zeros((24, 3))
    for i, (s, _) in first.items():
        table[i // 125, s] += 1
    assert ((table - 125 / 3) ** 2 / (125 / 3)).sum() < 2 * 46


def test_many_ranges_stay_gapless(spark):
    docs = spark.createDataFrame([(i,) for i in range(2000)], "doc_id long")
    out = S.shard_rows(docs, shards=2, rows_per_task=50).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(1000))


def test_small_empty_and_clashing(spark):
    few = S.shard_rows(spark.createDataFrame([(1, {"a": 1}), (2, None)], "doc_id long, m map<string,int>")).collect()
    assert sorted(r["shard"] for r in few) == [0, 1] and {r.slot for r in few} == {0}
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        S.shard_rows(spark.createDataFrame([(1, 2)], "doc_id long, Slot int"))


def test_shuffle_against_plain_python(spark):
    """Blocks, cuts and both permutations again, from the same hashes and the same matrix."""
    from pyspark.sql import functions as F

    from vecloom.llm.tables import row_hash

    docs = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i % 3}") for i in range(700)], "doc_id long, text string")
    shards, seed, blocks = 5, 17, 128
    got = {r.doc_id: (r["shard"], r.slot) for r in S.shard_rows(docs, shards=shards, rows_per_task=50).collect()}
    h = row_hash(docs, docs.columns, seed)
    rows = docs.select("doc_id", h.alias("h"), F.xxhash64(h, F.lit(seed + 1)).alias("u1"), F.xxhash64(h, F.lit(seed + 2)).alias("u2")).collect()
    members = {b: sorted((r for r in rows if r.h % 65_536 % blocks == b), key=lambda r: r.u1) for b in range(blocks)}
    matrix = S.communication_matrix([len(members[b]) for b in range(blocks)], [140] * 5, seed)
    held = {s: [] for s in range(shards)}
    for b in range(blocks):
        at = 0
        for s in range(shards):
            held[s] += members[b][at : at + matrix[b, s]]
            at += matrix[b, s]
    ranges = 8
    want = {r.doc_id: (s, k) for s in held for k, r in enumerate(sorted(held[s], key=lambda r: ((r.u2 >> 20) % ranges, r.u2)))}
    assert got == want


def test_rows_that_differ_in_a_map_or_in_where_a_null_stands(spark):
    from vecloom.llm.tables import row_hash

    kind = "m map<string,int>, s struct<a: map<string,array<map<int,string>>>>, a string, b string"
    rows = [({"x": 1}, ({"k": [{1: "a"}]},), "v", None), ({"x": 2}, ({"k": [{1: "a"}]},), "v", None), ({"x": 1}, ({"k": [{1: "b"}]},), "v", None), ({"x": 1}, ({"k": [{1: "a"}]},), None, "v"), (None, None, "v", None), ({"x": 1}, (None,), "v", None)]
    df = spark.createDataFrame(rows, kind)
    assert df.select(row_hash(df, df.columns, 1).alias("h")).distinct().count() == len(rows)
    swapped = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},)], "m map<string,int>")
    assert swapped.select(row_hash(swapped, ["m"], 1).alias("h")).distinct().count() == 1
    many = spark.createDataFrame([({"k": i},) for i in range(90)], "m map<string,int>").repartition(3)
    out = S.shard_rows(many, shards=4)
    first = {r.m["k"]: (r["shard"], r.slot) for r in out.collect()}
    again = {r.m["k"]: (r["shard"], r.slot) for r in S.shard_rows(many.repartition(5), shards=4).collect()}
    assert len(first) == 90 and first == again
