import random

import pytest

from vecloom.llm import language_id as L

LANGUAGES = "en de nl sv da no is fy af".split()


@pytest.mark.parametrize("count", [2, 9])
def test_clean_documents_of_a_large_family_stay(spark, count):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {lang: ["".join(rng.choice(letters) for _ in range(4)) for _ in range(6)] for lang in [*LANGUAGES, "fr"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(40)), lang) for i, lang in enumerate([*LANGUAGES[:count], "fr"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in L.document_languages(docs).collect()}
    assert all(out[i].lang_pred == lang and out[i].score > 0.5 for i, _, lang in rows)
    assert L.keep_recognised(docs).count() == len(rows)
