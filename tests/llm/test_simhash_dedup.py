import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.brute import components

from vecloom.llm import simhash_dedup as S


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= radius]
    comp = components(len(rows), links)
    low = {}
    for (i, _), c in zip(rows, comp):
        low[c] = min(i, low.get(c, i))
    return sorted((i, format(p, "016x"), low[c]) for (i, _), p, c in zip(rows, prints, comp))


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["É", "ß", "Of", "THE"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([40, 200, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base)) if i % 3 else [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1000 - i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE")]


def as_rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(S.simhash_components(docs)) == brute(rows)


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_every_segment_count_finds_all_links(spark, segments):
    rng = random.Random(segments)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            prints.add(y)
    df = spark.createDataFrame([(S._signed(x),) for x in prints], "fp long")
    got = {(min(r.src, r.dst), max(r.src, r.dst)) for r in S.fingerprint_links(df, segments=segments).collect()}
    signed = [S._signed(x) for x in prints]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want


def test_hot_parts_give_the_same_components(spark):
    rows = corpus(seed=4)
    prints = sorted({S._signed(plain_fingerprint(t)) for _, t in rows})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    plain = components(len(prints), [(prints.index(r.src), prints.index(r.dst)) for r in S.fingerprint_links(df).collect()])
    split = components(len(prints), [(prints.index(r.src), prints.index(r.dst)) for r in S.fingerprint_links(df, block_rows=2).collect()])
    assert plain == split


def test_very_long_text_and_slices():
    text = " ".join(f"x{i % 977}" for i in range(150_000))
    words = text.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert S.fingerprint(text) == want


def test_edges_empty_extra_columns_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string")
    assert S.simhash_components(empty).collect() == []
    rows = [(None, "a b c d e", "x"), (3, "a b c d e", "y"), (3, "a b c d e", "y"), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = S.simhash_components(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == [(-1, 3), (3, 3), (3, 3), (9, 9)]
    kept = S.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "a b c d e"), (9, None)]
    nobody = spark.createDataFrame([(None, "q", None), (None, "q", None)], "doc_id long, text string, fp string")
    assert S.keep_one_per_component(nobody).count() == 1


def test_keep_one_keeps_the_smallest_id(spark):
    rows = corpus(seed=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    want = sorted({c for _, _, c in brute(rows)})
    assert sorted(r.doc_id for r in S.keep_one_per_component(docs).collect()) == want


def test_rows_with_nulls_in_different_places_stay_apart(spark):
    from vecloom.llm import simhash_dedup as S

    rows = [(1, "one text of several words", None), (1, None, "one text of several words")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    assert sorted(map(str, S.keep_one_per_component(df).collect())) == sorted(map(str, df.collect()))
