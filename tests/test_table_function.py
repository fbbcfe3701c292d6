import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import ClusterSnapshot, HierarchicalSnapshot
from vecloom.operators.table_function import register
from vecloom.sources.tables import from_numpy


def rows(frame, names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_table_function_gives_what_assign_with_scores_gives(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 1, (60, 3)) for c in (0, 4, 9)])
    df = from_numpy(spark, x).withColumn("extra", F.concat(F.lit("r"), "id")).repartition(4)
    df = df.unionByName(spark.createDataFrame([(999, None, "none")], "id long, features array<double>, extra string"))
    df.createOrReplaceTempView("given_rows")
    snapshot = ClusterSnapshot(rng.normal(4, 4, (8, 3)), "euclidean").calibrate(df.where("id < 999"))
    snapshot.save(spark, str(tmp_path / "s"))
    for source, name in ((snapshot, "assign_held"), (str(tmp_path / "s"), "assign_saved")):
        register(spark, name, source)
        got = spark.sql(f"SELECT * FROM {name}(TABLE(given_rows))")
        want = snapshot.assign_with_scores(df)
        assert got.columns == want.columns
        keep = [c for c in got.columns if c != "features"]
        assert sorted(map(str, rows(got.where("id < 999"), keep))) == sorted(map(str, rows(want.where("id < 999"), keep)))
        assert got.where("id = 999").first()["label"] is None
    part = spark.sql("SELECT id, label, rejected FROM assign_held(TABLE(SELECT id, features FROM given_rows WHERE id < 90), confidence_threshold => 0.4)")
    want = snapshot.assign_with_scores(df.where("id < 90").select("id", "features"), confidence_threshold=0.4)
    assert rows(part, ("id", "label", "rejected")) == rows(want, ("id", "label", "rejected"))
    assert 0 < part.where("rejected").count() < 90


def test_two_levels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 4))
    df = from_numpy(spark, x)
    df.createOrReplaceTempView("two_level_rows")
    tree = HierarchicalSnapshot(ClusterSnapshot(x[:3], "euclidean"), {1: ClusterSnapshot(x[3:6], "euclidean")})
    register(spark, "assign_tree", tree)
    names = ["id", "root_label", "root_confidence", "root_rejected", "child_label", "child_confidence", "child_rejected", "rejected"]
    assert rows(spark.sql("SELECT * FROM assign_tree(TABLE(two_level_rows))"), names) == rows(tree.assign_with_scores(df), names)


def test_what_cannot_be_scored_is_refused_when_the_query_is_analyzed(spark):
    register(spark, "assign_strict", ClusterSnapshot(np.eye(3), "euclidean"))
    for query in (
        "SELECT * FROM assign_strict(TABLE(SELECT 1 AS id))",
        "SELECT * FROM assign_strict(TABLE(SELECT array(1D, 2D, 3D) AS features, 1 AS Label))",
        "SELECT * FROM assign_strict(TABLE(SELECT array(1D, 2D, 3D) AS features), adaptive_threshold => true)",
        "SELECT * FROM assign_strict(TABLE(SELECT array(1D, 2D, 3D) AS features), threshold => 1)",
    ):
        with pytest.raises(Exception):
            spark.sql(query)
    assert spark.sql("SELECT * FROM assign_strict(TABLE(SELECT array(1D, 0D, 0D) AS features))").first()["label"] == 0
