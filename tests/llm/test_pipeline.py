from collections import Counter

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash_dedup import brute as grouped

import corpus_pipeline
from vecloom.llm import language_id, mixing


def corpus():
    import random

    from tests.llm.test_language_id import corpus as spoken

    rng = random.Random(8)
    rows = [(i, t, lang, f"src{i % 3}", len(t)) for i, t, lang in spoken(260)]
    for i in range(260, 300):
        j = rng.randrange(260)
        rows.append((i, rows[j][1] + (" more" if i % 2 else ""), rows[j][2], "src0", 1))
    item = " ".join(f"zeta{k}" for k in range(20))
    for i in range(300, 310):
        rows.append((i, rows[i - 300][1] + " " + item + " the und", "en", "src1", 1))
    rows += [(400, None, "en", "src1", 0), (401, "12 34", None, "src1", 0), (402, rows[0][1], "en", None, 0)]
    return rows, [(1, item), (2, None)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    texts = {r[0]: r[1] for r in rows}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        following = stage(spark, current, str(tmp_path))
        before, after = ids(current), ids(following)
        if name == "language_id":
            model = language_id.train(current)
            labels, score = model.predict([texts[i] for i in before])
            assert after == [i for i, x, s in zip(before, labels, score) if x != "und" and s >= 0.3]
            assert not {400, 401} & set(after)
        elif name == "simhash_near_dedup":
            assert after == sorted({c for _, _, c in grouped([(i, texts[i]) for i in before])}) and len(after) < len(before)
        elif name == "benchmark_decontamination":
            assert after == [i for i in before if not contaminated(texts[i], items)] and not set(range(300, 310)) & set(after)
        elif name == "mixing_weights":
            chance = {r.doc_id: r.kept for r in mixing.document_mixture(current).collect()}
            assert after == [i for i in before if chance[i]] and 0 < len(after) < len(before)
        else:
            assert after == before
            out = following.collect()
            assert sorted(following.columns) == sorted([*docs.columns, "shard", "slot"])
            per = Counter(r["shard"] for r in out)
            assert max(per.values()) - min(per.values()) <= 1
        if k < 4:
            assert following.columns == docs.columns
        following.write.parquet(str(tmp_path / f"stage{k}"))
        current = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(name)
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(current)


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
