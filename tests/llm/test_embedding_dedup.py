import random

import numpy as np
import pytest
from tests.llm.brute import components

from vecloom.llm import embedding_dedup as E
from vecloom.llm import lattice


def cluster(rng, centre, n, spread):
    x = centre + spread * rng.normal(size=(n, len(centre))) / np.sqrt(len(centre))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def corpus(seed=1, big=90):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=64))
    rows = []
    for label in range(3):
        for n in (1, 1, 2, 5, 12, big if label == 0 else 8):
            rows += [(label, v.astype(np.float32).tolist()) for v in cluster(rng, unit(), n, rng.choice([0.05, 0.15, 0.2]))]
    rows += [rows[3]] * 4 + [(1, rows[0][1]), (None, rows[0][1])]
    random.Random(seed).shuffle(rows)
    return [(1000 + 7 * i, v, label) for i, (label, v) in enumerate(rows)]


def brute(rows, threshold=0.98):
    ok = []
    for i, v, label in rows:
        a = None if v is None else np.array([np.nan if x is None else x for x in v], dtype=np.float64)
        good = i is not None and label is not None and a is not None and len(a) and np.isfinite(a).all() and (a != 0).any()
        ok.append(a / np.linalg.norm(a) if good else None)
    links = [
        (x, y)
        for x in range(len(rows))
        for y in range(x)
        if ok[x] is not None and ok[y] is not None and rows[x][2] == rows[y][2] and len(ok[x]) == len(ok[y]) and ok[x] @ ok[y] >= threshold
    ]
    degree = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    comp = components(len(rows), links)
    low = {}
    for (i, _, _), c in zip(rows, comp):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    return sorted((i if i is not None else -1, int(n), low.get(c, -1), i is None or low[c] == i) for (i, _, _), n, c in zip(rows, degree, comp))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def got(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


@pytest.mark.parametrize("hot_rows,block_rows", [(64, 512), (256, 512), (5, 7), (20, 30)])
def test_matches_brute_force(spark, hot_rows, block_rows):
    rows = corpus()
    assert got(E.embedding_components(frame(spark, rows).repartition(4), hot_rows=hot_rows, block_rows=block_rows)) == brute(rows)


def test_unusable_rows_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [1.0, float("nan"), 3.0], 0)]
    rows += [(7, [1.0, float("inf"), 3.0], 0), (8, v, None), (9, v, 1), (10, [], 0), (11, [1.0, 2.0], 0), (None, v, 0), (12, [1e-30, 2e-30, 3e-30], 0), (2, [2.0, 4.0, 6.0], 0)]
    assert got(E.embedding_components(frame(spark, rows))) == brute(rows)
    assert E.embedding_components(frame(spark, [])).collect() == []


def at_cosine(cosine, n=3000, d=64, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=(n, d))
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * g


@pytest.mark.parametrize("rows", [1000, E.CODES_2_ROWS, E.CODES_2_ROWS + 1])
@pytest.mark.parametrize("d", [64, 384])
def test_recall_at_the_threshold(rows, d):
    a, b = at_cosine(0.98, 1500, d)
    met, group = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    for t in range(E.TABLES):
        x, y = (E.cell_keys(v, group, t, E.PROBES, *E.settings(rows)) for v in (a, b))
        met |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
    assert met.mean() > 0.99


def test_settings_and_links_do_not_change_with_the_size():
    assert len({E.settings(n) for n in (0, 1, 1000, E.CODES_2_ROWS, E.CODES_2_ROWS + 1, 10**9)}) == 1
    a, b = at_cosine(0.98, 4000, seed=9)
    met, group = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    for t in range(E.TABLES):  # any size: at least as many as two codes in five tables found (0.9999)
        x, y = (E.cell_keys(v, group, t, E.PROBES, *E.settings(E.CODES_2_ROWS + 1)) for v in (a, b))
        met |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
    assert met.mean() >= 0.9997


def test_chance_candidates_are_few():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share = []
    for rows in (1000, E.CODES_2_ROWS + 1):
        pairs = set()
        for t in range(E.TABLES):
            keys = E.cell_keys(x, np.zeros(len(x), np.int64), t, E.PROBES, *E.settings(rows))
            place = {}
            for k, own in enumerate(keys[:, 0].tolist()):
                place.setdefault(own, []).append(k)
            pairs |= {(min(k, m), max(k, m)) for k, row in enumerate(keys.tolist()) for key in row for m in place.get(key, ()) if m != k}
        share.append(len(pairs) / (len(x) * (len(x) - 1) / 2))
    assert share[0] < 3e-5 and share[1] < 1e-6


def test_query_on_a_table_with_links(spark, tmp_path):
    """The registered query itself: pairs just above and just below the threshold, copies, a large group."""
    from vecloom.llm.queries import op6_embedding_near_dedup

    a, b = at_cosine(0.9803, 150)
    c, d = at_cosine(0.9797, 150, seed=4)
    rng = np.random.default_rng(5)
    big = cluster(rng, a[0], 150, 0.1)
    x = np.vstack([a, b, c, d, big, a[:20]])
    rows = [(10 * i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found, want = got(op6_embedding_near_dedup(spark, str(tmp_path))), brute(rows)
    assert sum(r[1] for r in want) > 150 and found == want


def test_a_cosine_at_the_threshold_is_summed_in_order():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 64)), rng.normal(size=(30, 64))
    for i, j in ((0, 0), (7, 3), (39, 29)):
        threshold = float(np.cumsum(x[i] * y[j])[-1])
        assert E.linked_block(x, y, threshold)[i, j] and not E.linked_block(x, y, np.nextafter(threshold, np.inf))[i, j]


def test_lattice_decoding():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(300, 8)) * 2
    base = lattice.nearest_e8(y)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)
    twice = np.rint(2 * base)
    assert np.allclose(2 * base, twice) and (np.mod(base.sum(1), 2) == 0).all()
    distance = ((y - base) ** 2).sum(1)
    assert (distance <= 1 + 1e-9).all()  # the covering radius is 1
    others = ((y[:, None] - base[:, None] - lattice.ROOTS[None]) ** 2).sum(2)
    assert (others.min(1) >= distance - 1e-9).all()
    looked, farther = lattice.cells(y, 5)
    assert np.allclose(looked[:, 1:] / 2 - base[:, None], lattice.ROOTS[np.argsort(others, axis=1, kind="stable")[:, :5]])
    assert np.allclose(farther[:, 1:], np.sort(others, axis=1)[:, :5] - distance[:, None])


def test_nearest_cells_of_a_product():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(50, 16))
    looked = lattice.product_cells(y, 20) / 2
    ways = np.vstack([np.zeros(8), lattice.ROOTS])
    for row, points in zip(y, looked):
        base = [lattice.nearest_e8(row[None, :8])[0], lattice.nearest_e8(row[None, 8:])[0]]
        costs = [((row[8 * k : 8 * k + 8] - base[k] - ways) ** 2).sum(1) for k in (0, 1)]
        best = np.sort((costs[0][:, None] + costs[1][None, :]).ravel())[:21]
        assert np.allclose(((row - points) ** 2).sum(1), best) and len(set(map(tuple, points))) == 21
