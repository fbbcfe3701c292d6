import random

import numpy as np

from vecloom.llm import sentence_dedup as S


def say(rng, n, words=5000):
    return " ".join(f"W{rng.randrange(words)}" for _ in range(n))


def test_copies_go_without_comparing_each_of_their_stretches(spark, monkeypatch):
    rng = random.Random(1)
    text, written = say(rng, 600), {}
    docs = [(k, text) for k in range(40)] + [(100 + k, f"{say(rng, 30)} {text} {say(rng, 30)}") for k in range(2)]
    keep = S.materialized

    def counted(df, label="table", rows=None):
        table = keep(df, label, rows)
        written[label] = table.df.count()
        return table

    monkeypatch.setattr(S, "materialized", counted)
    out = {r.doc_id: r.text for r in S.document_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert out == {0: text, **{k: "" for k in range(1, 40)}, **{k: x.replace(text + " ", "") for k, x in docs[40:]}}
    assert written["stretches"] < 3 * 550  # 42 * 550 if each document's are compared


def test_a_stretch_is_found_in_whichever_surroundings_it_lies(spark):
    rng = random.Random(4)
    words = say(rng, 400).split()
    docs = [(k, " ".join([*words[(a := rng.randrange(300)) : a + rng.randint(40, 100)], say(rng, 9), *words[(b := rng.randrange(300)) : b + rng.randint(40, 100)]])) for k in range(60)]
    seen, want = set(), {}
    for i, text in docs:
        own = text.lower().split()
        stretches = [tuple(own[k : k + 51]) for k in range(len(own) - 50)]
        gone = {k + j for k, x in enumerate(stretches) if x in seen for j in range(51)}
        want[i] = [w for k, w in enumerate(text.split()) if k not in gone]
        seen |= set(stretches)
    out = {r.doc_id: r.text.split() for r in S.document_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert out == want


def test_texts_laid_out_together_hash_as_each_alone():
    rng = random.Random(2)
    p = " ".join(f"Sentence number {k} of the passage is here{'.!?'[k % 3]}" for k in range(9))
    texts = ["", " \n", p, f"\n {p}\n{say(rng, 70)}", f"後。 {p}", say(rng, 51), say(rng, 50), f"Äh. {p} naïve – “End.” {say(rng, 60)}", p.upper()]
    known = S._WordHashes()
    for longest in (None, 12):
        whole = S.Laid(texts, known, longest)
        for found in (lambda x: x.runs(), lambda x: x.seeds(50)):
            together = found(whole)
            for k, text in enumerate(texts):
                alone = found(S.Laid([text], S._WordHashes(), longest))
                mine = [np.atleast_2d(c).T[together[0] == k].tolist() for c in together[1:]]
                assert sorted(map(str, zip(*mine))) == sorted(map(str, zip(*(np.atleast_2d(c).T.tolist() for c in alone[1:]))))
        owner, both, begin, end = whole.runs()
        shared = [set(map(tuple, both.T[owner == k].tolist())) for k in (2, 3, 4, 7, 8)]
        assert shared[0] and shared[0] == shared[4] and all(shared[0] <= x for x in shared)
        assert all(texts[k][a:b].strip() for k, a, b in zip(owner, begin, end))
