"""Snapshots as SQL table functions: ``SELECT * FROM assign_topics(TABLE(rows))``.

A snapshot (of one level or two) is loaded once by the session that registers it and travels with the
function.  The function is polymorphic: its columns are those of the table it is given and the scores of
``assign_with_scores``, settled when a query is analyzed, so a clash of names or vectors of another length
are refused before anything runs.  Rows are handed over one by one, as Spark does for functions with a schema
of their own, and scored ``BATCH`` at a time in a narrow pass: convenient in SQL, while
``assign_with_scores`` stays the faster way for large tables.  Thresholds are named constants:

    SELECT label, count(*) FROM assign_topics(TABLE(SELECT id, features FROM docs), confidence_threshold => 0.2) GROUP BY label
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vecloom.operators.hierarchy import HierarchicalSnapshot
from vecloom.operators.snapshot import ClusterSnapshot

BATCH = 1024
_LONG, _DOUBLE, _FLAG = T.LongType(), T.DoubleType(), T.BooleanType()
ONE_LEVEL = [("label", _LONG), ("distance", _DOUBLE), ("second_distance", _DOUBLE), ("confidence", _DOUBLE), ("rejected", _FLAG)]
TWO_LEVELS = [("root_label", _LONG), ("root_confidence", _DOUBLE), ("root_rejected", _FLAG), ("child_label", _LONG), ("child_confidence", _DOUBLE), ("child_rejected", _FLAG), ("rejected", _FLAG)]
THRESHOLDS = {"distance_threshold": float, "confidence_threshold": float, "adaptive_threshold": bool, "adaptive_percentile": str, "boundary_mode": str}


def _levels(snapshot) -> tuple[str, list, list]:
    """(feature column, added columns, snapshots that thresholds must suit)."""
    if isinstance(snapshot, HierarchicalSnapshot):
        return snapshot.root.features, TWO_LEVELS, [snapshot.root, *snapshot.children.values()]
    return snapshot.features, ONE_LEVEL, [snapshot]


def table_function(snapshot: ClusterSnapshot | HierarchicalSnapshot):
    """The snapshot as a user-defined table function (its first argument is the table)."""
    features, added, parts = _levels(snapshot)
    two_levels = added is TWO_LEVELS
    unknown = (None,) * len(added) if two_levels else (*[None] * (len(added) - 1), False)

    class Assign:
        @staticmethod
        def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument is a table")
            known = {}
            for name, argument in given.items():
                if name not in THRESHOLDS:
                    raise ValueError(f"{name} is not one of {sorted(THRESHOLDS)}")
                if not argument.isConstantExpression:
                    raise ValueError(f"{name} must be a constant")
                known[name] = argument.value
            for part in parts:
                part.check_thresholds(**known)
            fields = table.dataType.fields
            kind = next((f.dataType for f in fields if f.name.lower() == features.lower()), None)
            if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
                raise ValueError(f"the table needs a column {features} of arrays of numbers")
            clash = {n for n, _ in added} & {f.name.lower() for f in fields}
            if clash:
                raise ValueError(f"the table already has columns {sorted(clash)}")
            return AnalyzeResult(T.StructType([*fields, *[T.StructField(n, k) for n, k in added]]))

        def __init__(self):
            self.held, self.known = [], {}

        def eval(self, table: Row, **given):
            if not self.held:
                self.known = {k: THRESHOLDS[k](v) for k, v in given.items() if v is not None}
                self.at = next(i for i, n in enumerate(table.__fields__) if n.lower() == features.lower())
            self.held.append(tuple(table))
            if len(self.held) >= BATCH:
                yield from self._scores()

        def terminate(self):
            yield from self._scores()

        def _scores(self):
            held, self.held = self.held, []
            vectors = [r[self.at] for r in held if r[self.at] is not None] if held else []
            if vectors:
                x = np.array(vectors, dtype=np.float64)
                made = snapshot.scored(x, self.known) if two_levels else snapshot.judged(x, **self.known)
                found = iter(zip(*(m.tolist() for m in made)))
            for r in held:  # rows without a vector have no scores; one level does not count them as rejected
                yield r + (next(found) if r[self.at] is not None else unknown)

    return udtf(Assign)


def register(spark: SparkSession, name: str, snapshot: ClusterSnapshot | HierarchicalSnapshot | str):
    """Register a snapshot, or what is saved at a path, as the table function ``name``."""
    if isinstance(snapshot, str):
        held = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot}/hierarchy")
        two = held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)
        snapshot = (HierarchicalSnapshot if two else ClusterSnapshot).load(spark, snapshot)
    return spark.udtf.register(name, table_function(snapshot))
