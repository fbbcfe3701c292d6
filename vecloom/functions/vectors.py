"""Vector arithmetic as Column expressions over ARRAY<DOUBLE> and as SQL functions.

Sums run in index order in double precision.  Euclidean distance is squared unless named otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = {"euclidean": "euclidean", "l2": "euclidean", "cosine": "cosine", "manhattan": "manhattan", "cityblock": "manhattan", "l1": "manhattan"}


def parse_metric(name: str) -> str:
    """The metric a name or alias stands for, whatever its case."""
    try:
        return METRICS[str(name).lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; use one of {sorted(METRICS)}") from None


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x * x))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 wherever a vector is zero, even against itself."""
    scale = norm2(a) * norm2(b)
    return F.when(scale <= 0, F.lit(1.0)).otherwise(1 - dot(a, b) / F.sqrt(scale))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The raw distance of a metric (squared for Euclidean)."""
    return {"euclidean": squared_euclidean, "cosine": cosine_distance, "manhattan": manhattan}[parse_metric(metric)](a, b)


def to_metric(metric: str, raw: Column) -> Column:
    return F.sqrt(raw) if parse_metric(metric) == "euclidean" else raw


def angular(a: Column, b: Column) -> Column:
    """Angle between unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def l2_normalize(a: Column) -> Column:
    """Unit vector; unchanged where the squared norm is at most 1e-30."""
    length2 = norm2(a)
    return F.when(length2 > 1e-30, _scaled(a, 1 / F.sqrt(length2))).otherwise(a)


def _scaled(a: Column, factor: Column) -> Column:
    """Every component times a factor; bound as an outer variable, it is computed once, not once a component."""
    return F.element_at(F.transform(F.array(factor), lambda k: F.transform(a, lambda x: x * k)), 1)


def truncate(a: Column, size: int) -> Column:
    """The first ``size`` dimensions, normalized again."""
    return l2_normalize(F.slice(a, 1, size))


def fuse_views(a: Column, b: Column, weight_a: float = 1.0, weight_b: float = 1.0) -> Column:
    """Two views of a row as one unit vector, weighted by the roots of their weights."""
    part = lambda v, w: F.transform(v, lambda x: x * F.lit(float(w) ** 0.5))
    return l2_normalize(F.concat(part(a, weight_a), part(b, weight_b)))


def mahalanobis(a: Column, centre: Column, variance: Column) -> Column:
    """Squared distance with a diagonal covariance."""
    return _total(F.zip_with(F.zip_with(a, centre, lambda x, c: (x - c) * (x - c)), variance, lambda d, v: d / v))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence_distance(best: Column, second: Column) -> Column:
    """1 - best/second within [0, 1]; 0 where there is no usable second."""
    usable = second.isNotNull() & ~F.isnan(second) & (F.abs(second) != float("inf")) & (F.abs(second) >= 1e-30)
    return F.when(usable, 1 - _clamped(best / second)).otherwise(0.0)


def confidence_dot(best: Column, second: Column) -> Column:
    """1 - second/best within [0, 1] for similarities; 0 where best is about zero or there is no second."""
    usable = second.isNotNull() & ~F.isnan(second) & (F.abs(second) != float("inf")) & (F.abs(best) >= 1e-30)
    return F.when(usable, 1 - _clamped(second / best)).otherwise(0.0)


def kappa_of(resultant: Column, dim) -> Column:
    """Concentration from the resultant length, as snapshots use it."""
    r = resultant
    return r * (F.lit(dim) - r * r) / F.greatest(1 - r * r, F.lit(1e-10))


def kappa_banerjee(resultant: Column, dim) -> Column:
    r = resultant
    return (r * F.lit(dim) - r * r * r) / F.greatest(1 - r * r, F.lit(1e-30))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """The same functions for SQL, as temporary functions written in SQL."""
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    vec = "ARRAY<DOUBLE>"
    usable = "CASE WHEN second IS NOT NULL AND NOT isnan(second) AND abs(second) <> double('Infinity') AND abs({}) >= 1e-30D THEN 1 - greatest(0D, least(1D, {})) ELSE 0D END"
    bodies = {
        "vec_dot": (f"a {vec}, b {vec}", "DOUBLE", total.format("zip_with(a, b, (x, y) -> x * y)")),
        "vec_norm2": (f"a {vec}", "DOUBLE", total.format("transform(a, x -> x * x)")),
        "vec_squared_euclidean": (f"a {vec}, b {vec}", "DOUBLE", total.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))")),
        "vec_manhattan": (f"a {vec}, b {vec}", "DOUBLE", total.format("zip_with(a, b, (x, y) -> abs(x - y))")),
        "vec_cosine_distance": (f"a {vec}, b {vec}", "DOUBLE", "CASE WHEN vec_norm2(a) * vec_norm2(b) <= 0 THEN 1D ELSE 1 - vec_dot(a, b) / sqrt(vec_norm2(a) * vec_norm2(b)) END"),
        "vec_angular": (f"a {vec}, b {vec}", "DOUBLE", "acos(greatest(-1D, least(1D, vec_dot(a, b))))"),
        "vec_l2_normalize": (f"a {vec}", vec, "CASE WHEN vec_norm2(a) > 1e-30D THEN element_at(transform(array(1 / sqrt(vec_norm2(a))), k -> transform(a, x -> x * k)), 1) ELSE a END"),
        "vec_truncate": (f"a {vec}, n INT", vec, "vec_l2_normalize(slice(a, 1, n))"),
        "vec_fuse_views": (f"a {vec}, b {vec}, wa DOUBLE, wb DOUBLE", vec, "vec_l2_normalize(concat(transform(a, x -> x * sqrt(wa)), transform(b, x -> x * sqrt(wb))))"),
        "vec_mahalanobis": (f"a {vec}, centre {vec}, variance {vec}", "DOUBLE", total.format("zip_with(zip_with(a, centre, (x, c) -> (x - c) * (x - c)), variance, (d, v) -> d / v)")),
        "vec_confidence_distance": ("best DOUBLE, second DOUBLE", "DOUBLE", usable.format("second", "best / second")),
        "vec_confidence_dot": ("best DOUBLE, second DOUBLE", "DOUBLE", usable.format("best", "second / best")),
        "vec_kappa": ("r DOUBLE, dim INT", "DOUBLE", "r * (dim - r * r) / greatest(1 - r * r, 1e-10D)"),
        "vec_kappa_banerjee": ("r DOUBLE, dim INT", "DOUBLE", "(r * dim - r * r * r) / greatest(1 - r * r, 1e-30D)"),
    }
    for name, (arguments, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(bodies)
