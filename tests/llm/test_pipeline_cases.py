"""Cases the pipeline's docstring names: clashes, repeats, null ids, extra columns, very long texts, empty tables."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, rows, extra="", more=()):
    spark.createDataFrame([(*r, *more) for r in rows], SCHEMA + extra).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def spoken(n=160):
    from tests.llm.test_language_id import corpus

    return [(i, t, lang, f"src{i % 2}", len(t)) for i, t, lang in corpus(n)]


@pytest.mark.parametrize("name", ["shard", "Slot"])
def test_a_clashing_column_is_refused_before_the_first_stage(spark, tmp_path, name):
    path = written(spark, tmp_path, spoken(20), f", {name} int", (1,))
    with pytest.raises(ValueError, match=name.lower()):
        corpus_pipeline.run(spark, path)


def test_repeats_null_ids_extra_columns_and_long_texts(spark, tmp_path):
    rows = spoken()
    rng = random.Random(3)
    words = rows[0][1].split()
    long = " ".join(rng.choice(words) + str(k % 7) * (k % 11 == 0) for k in range(60_000))
    rows += [rows[5], rows[5], (None, rows[7][1], rows[7][2], "src0", 1), (None, "only " + rows[9][1] + " here and nowhere else at all today", rows[9][2], None, 1), (900, long, rows[0][2], "src1", len(long))]
    path = written(spark, tmp_path, rows, ", component map<string,int>, `ran.ge` string", ({"k": 1}, "x"))
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    second = corpus_pipeline.STAGES[1][1](spark, first, path)
    kept = [r.doc_id for r in second.select("doc_id").collect()]
    assert kept.count(5) <= 1 and 900 in kept
    assert second.where("doc_id IS NULL").count() <= 1  # the copy of document 7 gave way to it
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "component", "ran.ge", "shard", "slot"]
    found = out.collect()
    assert 0 < len(found) <= len(kept) and all(r["component"] == {"k": 1} and r["ran.ge"] == "x" for r in found)
    assert all(r.text == long for r in found if r.doc_id == 900)


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    path = written(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, path)
    assert out.collect() == [] and out.columns[-2:] == ["shard", "slot"]
