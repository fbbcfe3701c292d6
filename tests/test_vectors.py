import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import directional as D
from vecloom.functions import vectors as V


def one(spark, a, b, column):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(column(F.col("a"), F.col("b")).alias("v")).first()["v"]


def test_exact_small_values(spark):
    assert one(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], V.squared_euclidean) == 27
    assert one(spark, [1.0, 2.0, 3.0], [4.0, 6.0, 0.0], V.manhattan) == 10
    assert one(spark, [0.0, 0.0], [0.0, 0.0], V.cosine_distance) == 1
    assert one(spark, [1.0, 0.0], [-2.0, 0.0], V.cosine_distance) == 2
    assert one(spark, [3.0, 4.0], [0.0], lambda a, b: V.l2_normalize(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], [0.0], lambda a, b: V.l2_normalize(a)) == [0, 0]
    assert one(spark, [3.0, 4.0, 9.0], [0.0], lambda a, b: V.truncate(a, 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, [1.0, 0.0], [0.0, 1.0], V.angular) == pytest.approx(math.pi / 2)
    fused = one(spark, [1.0], [1.0], lambda a, b: V.fuse_views(a, b, 3.0, 1.0))
    assert fused == pytest.approx([math.sqrt(0.75), 0.5])
    assert one(spark, [5.0, 8.0], [0.0, 0.0], lambda a, b: V.mahalanobis(a, b, F.array(F.lit(1.0), F.lit(100.0)))) == pytest.approx(25.64)


def test_confidences(spark):
    cases = [(1.0, 4.0), (0.0, 0.0), (1.0, float("inf")), (2.0, 1.0)]
    rows = spark.createDataFrame(cases, "b double, s double").select(V.confidence_distance(F.col("b"), F.col("s")).alias("d"), V.confidence_dot(F.col("b"), F.col("s")).alias("p")).collect()
    assert [r.d for r in rows] == [0.75, 0, 0, 0] and [r.p for r in rows] == [0, 0, 0, 0.5]


def test_metric_names():
    assert [V.parse_metric(x) for x in ("L2", "cityblock", "L1", "Cosine")] == ["euclidean", "manhattan", "manhattan", "cosine"]
    with pytest.raises(ValueError):
        V.parse_metric("hamming")


def test_sql_functions_agree(spark):
    V.register_sql_functions(spark)
    r = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS a, vec_l2_normalize(array(3D, 4D)) AS b, vec_cosine_distance(array(0D), array(1D)) AS c, vec_truncate(array(3D, 4D, 5D), 2) AS d").first()
    assert r.a == 11 and r.b == pytest.approx([0.6, 0.8]) and r.c == 1 and r.d == pytest.approx([0.6, 0.8])


def test_sql_functions_of_snapshots_agree(spark):
    V.register_sql_functions(spark)
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    cases = {
        "vec_mahalanobis(array(5D, 8D), array(0D, 0D), array(1D, 100D))": V.mahalanobis(vec(5, 8), vec(0, 0), vec(1, 100)),
        "vec_confidence_distance(1D, 4D)": V.confidence_distance(F.lit(1.0), F.lit(4.0)),
        "vec_confidence_distance(1D, double('Infinity'))": V.confidence_distance(F.lit(1.0), F.lit(float("inf"))),
        "vec_confidence_dot(2D, 1D)": V.confidence_dot(F.lit(2.0), F.lit(1.0)),
        "vec_kappa(0.6D, 8)": V.kappa_of(F.lit(0.6), 8),
        "vec_kappa_banerjee(0.6D, 8)": V.kappa_banerjee(F.lit(0.6), 8),
        "vec_fuse_views(array(1D, 2D), array(3D), 2D, 0.5D)[1]": F.element_at(V.fuse_views(vec(1, 2), vec(3), 2.0, 0.5), 2),
    }
    for text, column in cases.items():
        row = spark.range(1).select(F.expr(text).alias("a"), column.alias("b")).first()
        assert row.a == pytest.approx(row.b), text


def _bessel(nu, x):
    t = np.linspace(0, np.pi, 40001)
    return np.trapezoid(np.exp(x * (np.cos(t) - 1)) * np.sin(t) ** (2 * nu), t) * (x / 2) ** nu / (math.sqrt(math.pi) * math.gamma(nu + 0.5)), x


@pytest.mark.parametrize("nu", [0.5, 3.0, 15.0, 31.0])
@pytest.mark.parametrize("x", [0.1, 1.0, 8.0, 40.0, 300.0])
def test_bessel_and_ratio(nu, x):
    value, shift = _bessel(nu, x)
    assert D.log_bessel_i(nu, x) == pytest.approx(math.log(value) + shift, abs=2e-5)
    upper, _ = _bessel(nu + 1, x)
    assert D.bessel_ratio(x, int(2 * (nu + 1))) == pytest.approx(upper / value, rel=1e-6)


@pytest.mark.parametrize("kappa", [0.5, 5.0, 60.0, 900.0])
def test_kappa_is_recovered(kappa):
    assert D.estimate_kappa(D.bessel_ratio(kappa, 16), 16) == pytest.approx(kappa, rel=1e-3)
    assert D.estimate_kappa(0.0, 16) == 1e-6 and D.estimate_kappa(1.0, 16) == 1e6
