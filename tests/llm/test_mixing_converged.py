from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_mixing import brute
from vecloom.llm import mixing as M


def marginals(spark, rows, targets, dims=M.DIMS, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, topic string, n long")
    _, cells, _ = M.mixed(docs, {d: F.col(d) for d in dims}, F.col("n"), targets=targets, **options)
    sums, weight = defaultdict(float), {}
    for r in cells.collect():
        weight[tuple(r[d] for d in dims)] = r.weight
        for d in dims:
            sums[d, r[d]] += r.weight
    return sums, weight


ROWS = [("hot", "en", "a", 800), ("hot", "en", "b", 100), ("hot", "de", "a", 60), ("hot", "de", "b", 90)]
ROWS += [("cold", "en", "a", 120), ("cold", "en", "b", 50), ("cold", "de", "b", 800), ("cold", "de", "a", 200)]


def test_dependent_marginals_meet_their_targets(spark):
    # each source is mostly in one language
    targets = {"source": {"hot": 0.5, "cold": 0.5}, "lang": {"en": 0.3, "de": 0.7}, "topic": {"a": 0.5, "b": 0.5}}
    for budget in (0.05, 0.3):  # with the larger one some cells are taken whole
        sums, weight = marginals(spark, ROWS, targets, budget=budget)
        for d, own in targets.items():
            for v, t in own.items():
                assert sums[d, v] == pytest.approx(t, rel=1e-6)
        want = brute({r[:3]: r[3] for r in ROWS}, list(targets.values()), budget)
        assert all(weight[k] == pytest.approx(w, rel=1e-5, abs=1e-9) for k, w in want.items())
    assert any(weight[r[:3]] == pytest.approx(r[3] / (0.3 * 2220)) for r in ROWS)


def test_targets_beyond_what_there_is_are_cut_and_said(spark):
    with pytest.warns(UserWarning, match="more tokens than"):
        sums, _ = marginals(spark, ROWS, {"lang": {"en": 0.9, "de": 0.1}}, dims=("source", "lang"), budget=0.5)
    assert sums["lang", "en"] == pytest.approx(1070 * 0.9 / (0.5 * 2220), rel=1e-6) and sums["lang", "en"] + sums["lang", "de"] == pytest.approx(1)


def test_contradicting_targets_are_reported(spark):
    rows = [("s", "en", "a", 10), ("t", "de", "a", 10)]
    with pytest.warns(UserWarning, match="miss their targets"):
        marginals(spark, rows, {"source": {"s": 0.5, "t": 0.5}, "lang": {"en": 0.2, "de": 0.8}}, sweeps=4)
