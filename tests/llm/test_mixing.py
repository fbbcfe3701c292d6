import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecloom.llm import mixing as M


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice(["a | b ", "WOW!! ", "x### ", "plain words ", "écrit, 文字 "]) * rng.randint(1, 80)
        rows.append((i, text, rng.choice(["en"] * 6 + ["de", "fr", None]), rng.choice(["src0"] * 5 + [f"src{k}" for k in range(6)])))
    return rows + [(900, None, "en", "src1"), (901, "", "xx", "only"), (None, "plain", "en", None), (5, "again", "en", "src0"), (5, "again", "en", "src0")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def fill(raw, most, whole):
    """{value: share}: factor * raw, none above its most, summing to the whole; by bisection."""
    low, high = 0.0, 1e18
    for _ in range(400):
        mid = (low + high) / 2
        if sum(min(mid * raw[k], most[k]) for k in raw) < whole:
            low = mid
        else:
            high = mid
    return low, {k: min(low * raw[k], most[k]) for k in raw}


def brute(cells, targets, budget, sweeps=400):
    """cells: {(s, l, t): tokens}; bounded raking of a dense table, each factor by bisection."""
    total = sum(cells.values())
    u = {k: v / total for k, v in cells.items() if v}
    most = {k: cells[k] / (budget * total) for k in u}
    for _ in range(sweeps):
        for axis, wanted in enumerate(targets):
            for value, goal in wanted.items():
                own = {k: u[k] for k in u if k[axis] == value}
                f = fill(own, most, goal)[0] if goal else 0.0
                u |= {k: v * f for k, v in own.items()}
        off = max(abs(sum(min(u[k], most[k]) for k in u if k[a] == v) - g) for a, w in enumerate(targets) for v, g in w.items())
        if off < 1e-12:
            break
    return {k: min(u[k], most[k]) for k in u}


def natural_targets(cells, budget):
    targets = []
    for axis, dim in enumerate(M.DIMS):
        own = defaultdict(float)
        for k, v in cells.items():
            if v:
                own[k[axis]] += v
        most = {k: v * M.reserve_of(budget) / (budget * sum(own.values())) for k, v in own.items()}
        targets.append(fill({k: v ** M.FLATTEN[dim] for k, v in own.items()}, most, 1.0)[1])
    return targets


def test_probabilities_against_brute_force(spark):
    rows = corpus()
    out = M.document_mixture(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    cells, by_id = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
        if r.doc_id != 5:
            assert r.n_tokens == len(re.findall(r"\w+|[^\w\s]+", by_id[r.doc_id] or ""))
    targets = natural_targets(cells, M.BUDGET)
    weight = brute(cells, targets, M.BUDGET)
    total = sum(cells.values())
    for r in out:
        k = (r.source, r.lang, r.topic)
        p = min(1, weight[k] * M.BUDGET * total / cells[k]) if cells[k] else 0
        assert r.probability == pytest.approx(p, abs=3e-6)
        u = int(hashlib.md5(f"{M.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.kept == (u < p)


@pytest.mark.parametrize("seed,n", [(2, 500), (7, 60), (11, 2000)])
def test_the_sample_meets_every_marginal(spark, seed, n):
    """Expected tokens of the sample, from the probabilities of the documents themselves."""
    out = M.document_mixture(frame(spark, corpus(n, seed))).collect()
    cells, expected = defaultdict(int), [defaultdict(float) for _ in M.DIMS]
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
        assert 0 <= r.probability <= 1
        for axis, dim in enumerate(M.DIMS):
            expected[axis][r[dim]] += r.n_tokens * r.probability
    whole = sum(cells.values()) * M.BUDGET
    for axis, wanted in enumerate(natural_targets(cells, M.BUDGET)):
        for value, share in wanted.items():
            assert expected[axis][value] == pytest.approx(share * whole, rel=1e-3)


def test_sql_gives_the_same_rows(spark):
    for rows in (corpus(seed=5), [(1, None, "en", "s"), (2, " ", "de", None)]):
        con = duckdb.connect()
        con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}).replace({np.nan: None}))
        got = con.execute(M.mixture_sql()).fetchall()
        names = [c[0] for c in con.description]
        out = M.document_mixture(frame(spark, rows))
        assert sorted(map(repr, got)) == sorted(repr(tuple(r[n] for n in names)) for r in out.collect())


def test_given_targets_budget_and_passing_columns(spark):
    docs = frame(spark, corpus(1500)).withColumn("Tokens", F.lit("x")).withColumn("__kept", F.lit(1))
    targets = {"lang": {"en": 0.4, "de": 0.3, "absent": 0.3}, "topic": {"prose": 1.0}}
    placed, cells, names = M.mixed(docs, M.document_dims(), M.token_count(F.col("text")), targets=targets, budget=0.05)
    assert all(c in placed.columns for c in docs.columns)
    got = {(r.source, r.lang, r.topic): (r.weight, r.tokens, r.probability) for r in cells.collect()}
    by = defaultdict(float)
    for (_, lang, topic), (w, _, _) in got.items():
        by[lang] += w
        by["topic", topic] += w
    assert by["topic", "prose"] == pytest.approx(1) and by["en"] == pytest.approx(0.4 / 0.7, rel=1e-6) and by["de"] == pytest.approx(0.3 / 0.7, rel=1e-6)
    assert sum(t * p for _, t, p in got.values()) == pytest.approx(0.05 * sum(t for _, t, _ in got.values()), rel=1e-6)


def test_empty_and_all_wordless(spark):
    assert M.document_mixture(frame(spark, [])).collect() == []
    out = M.document_mixture(frame(spark, [(1, None, None, None), (2, "", "en", "s")])).collect()
    assert all(r.kept and r.probability == 1.0 for r in out)
    docs = frame(spark, corpus(80))
    kept = M.keep_sampled(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < 85


def test_no_python_in_the_plan(spark):
    plan = M.document_mixture(frame(spark, corpus(20)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
