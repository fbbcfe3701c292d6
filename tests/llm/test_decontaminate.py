import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import decontaminate as D


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(text, items):
    words = re.findall(r"\w+", (text or "").lower())
    best = {}
    for item, t in items:
        own = re.findall(r"\w+", (t or "").lower())
        if not own:
            continue
        k = min(5, len(own))
        want = grams(own, k)
        for s in range(len(words) - len(own) + 1):
            got = grams(words[s : s + len(own)], k)
            value = sum((got & want).values()) / sum((got | want).values())
            if value >= 0.8:
                best[item] = max(value, best.get(item, 0))
    return best


def material(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["Él", "größe"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([12, 25, 40, 60])))) for i in range(30)]
    items += [(100, "one two"), (101, "Solo"), (102, ""), (103, None), (None, "w1 w2 w3 w4 w5 w6"), (104, "w7 w7 w7 w7 w7 w7 w7 w8"), (105, items[0][1].upper())]
    docs = []
    for i in range(120):
        words = say(rng.randint(0, 150))
        if i % 2:
            leak = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                leak[rng.randrange(len(leak))] = rng.choice(vocab)
            if i % 5 == 0:
                leak = leak[: len(leak) * 3 // 4]
            at = rng.randint(0, len(words))
            words[at:at] = leak
        docs.append((i, rng.choice([" ", "\n", " ### "]).join(words)))
    docs += [(200, None), (201, ""), (202, "ONE, two!"), (203, "x solo y"), (204, "w7 " * 30), (205, "w7 " * 7 + "w8"), (205, "w7 " * 7 + "w8"), (None, items[3][1])]
    return items, docs


def test_matches_brute_force(spark):
    items, docs = material()
    out = D.document_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, tuple(r.item_ids), r.similarity, r.contaminated, r.n_items) for r in out.collect())
    want = Counter()
    for i, t in docs:
        best = brute(t, items)
        want[i, tuple(sorted(best, key=lambda i: (i is None, i))), round(max(best.values(), default=0.0), 6), bool(best), len(best)] += 1
    assert got == want
    assert sum(k[3] for k in got) > 15


def test_blocks_of_the_benchmark_give_the_same(spark):
    items, rows = material(2)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, Key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = D.with_matches(docs, bench)
    many = D.with_matches(docs, bench, max_items=7)
    assert one.columns == many.columns
    flat = lambda df: Counter((r.doc_id, tuple(sorted((m.item_id, m.similarity) for m in r.matches))) for r in df.collect())
    assert flat(one) == flat(many)
    assert len(D.benchmark_blocks(bench, max_items=7)) > 3 and len(D.benchmark_blocks(bench, max_bytes=500)) > 3


def test_table_finds_everything_within_the_radius():
    rng = np.random.default_rng(4)
    index = D.WindowIndex(40, D.RADIUS, D.BLOCKS)
    for k in range(60):
        index.add(k, rng.integers(0, 2**63, 36).astype(np.uint64))
    for _ in range(300):
        print_ = index.items[rng.integers(60)][1]
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            print_ ^= 1 << int(b)
        assert index.within_radius(print_) == {k for k, it in enumerate(index.items) if bin(it[1] ^ print_).count("1") <= D.RADIUS}


def test_similar_windows_lie_within_the_radius():
    rng = np.random.default_rng(5)
    apart = []
    for _ in range(2000):
        codes = rng.integers(0, 2**63, 40).astype(np.uint64)
        other = codes.copy()
        other[:4] = rng.integers(0, 2**63, 4)  # similarity 36 / 44 = 0.82
        apart.append(bin(D.simhash(codes) ^ D.simhash(other)).count("1"))
    assert np.mean(np.array(apart) <= D.RADIUS) > 0.999


def test_filter_keeps_columns_and_clean_rows(spark):
    items, rows = material(3)
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    want = Counter((i, t) for i, t in rows if not brute(t, items))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    nothing = bench.where(F.lit(False))
    assert D.keep_clean(docs, nothing).count() == len(rows)
    assert D.document_contamination(docs.where(F.lit(False)), bench).collect() == []


def test_very_long_text(spark):
    item = " ".join(f"q{k}" for k in range(30))
    text = "filler words here " * 60_000 + item + " tail " * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = D.document_contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert out.contaminated and out.item_ids == [9] and out.similarity == 1.0


def test_identifiers_of_any_type(spark):
    items = spark.createDataFrame([("q-1", "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven"), (3, "clean")], "doc_id long, text string")
    for limits in ({}, {"max_items": 1}):
        out = {r.doc_id: [m.item_id for m in r.matches] for r in D.with_matches(docs, items, **limits).collect()}
        assert out == {1: ["q-1"], 2: [None], 3: []}
