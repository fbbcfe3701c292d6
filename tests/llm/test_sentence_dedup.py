import random
import re
from collections import Counter

from vecloom.llm import sentence_dedup as S


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 5, 9, 30]))).capitalize() + rng.choice(". ? ! .".split())
    passages = [" ".join(sentence() for _ in range(9)) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [sentence() for _ in range(rng.randint(0, 10))]
        if i % 2:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        docs.append((n - i, rng.choice([" ", "\n"]).join(parts)))
    return docs, passages


def brute(rows):
    """Sets of removed sentences by (id, text), from all runs compared one with another."""
    seen, gone = {}, {}
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: (r[0], r[1], 0))
    runs = []
    for none, i, t in order:
        found = S.sentences(t)
        words = [tuple(t[a:b].lower().split()) for a, b, _, _ in found]
        for k in range(len(found)):
            for stop in range(k + S.RUN, len(found) + 1):
                if sum(map(len, words[k:stop])) >= S.WORDS:
                    runs.append(((none, i, t), k, stop, tuple(words[k:stop])))
                    break
    for key, k, stop, run in runs:
        if run in seen and seen[run] != (key, k):
            gone.setdefault(key, set()).update(range(k, stop))
        seen.setdefault(run, (key, k))
    return gone


def test_matches_brute_force(spark):
    docs, passages = corpus()
    out = S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    gone = brute(docs)
    assert len(gone) > 15
    for r in out:
        found = S.sentences(r.text)
        cut = gone.get((False, r.doc_id, r.text), set())
        assert r.kept_text == "".join(r.text[a:b] for k, (a, b, _, _) in enumerate(found) if k not in cut)
        assert "".join(r.text[s.start : s.end] for s in r.removed) == "".join(r.text[a:b] for k, (a, b, _, _) in enumerate(found) if k in cut)
    for p in passages:
        core = " ".join(p.split()[1:-1])
        assert sum(core in re.sub(r"\s+", " ", r.kept_text) for r in out) == 1


def test_sentences_cover_the_text_and_cut_alike():
    docs, passages = corpus(2)
    for text in [t for _, t in docs] + ["", "  ", "\n\n a. b", "word " * 500, "x" * 9000, "A. B! C?\nD", " lead. in"]:
        found = S.sentences(text)
        assert not found or (found[0][0] == 0 and found[-1][1] == len(text))
        assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert sum(f[2] for f in found) == len(text.split())
    long = " ".join(f"v{k}" for k in range(300))
    alone = {f[3] for f in S.sentences(long, 12)[1:-1]}
    assert alone <= {f[3] for f in S.sentences("Some other start " + long + " and end.", 12)}


def test_clean_texts_stay_and_short_repeats_too(spark):
    rng = random.Random(7)
    docs = [(i, ". ".join(f"S{rng.random()} so it is" for _ in range(20)) + ". Yes. No. Of course.") for i in range(30)]
    out = S.document_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in out} == set(docs) and {r.n_removed for r in out} == {0}


def test_nulls_repeats_empty_clashes_and_long(spark):
    p = " ".join(f"Sentence number {k} of the passage is here." for k in range(6))
    rows = [(3, p, "x"), (3, p, "x"), (1, p + " More.", "y"), (None, p, "z"), (4, None, "n"), (5, "", "e"), (3, "Other. " + p, "v"), (9, ("Filler line goes here now. " * 4000) + p, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    out = S.deduplicated(docs).collect()
    assert len(out) == len(rows)
    left = Counter((r.doc_id, r.places, r.kept_text) for r in out)
    assert left[1, "y", p + " More."] == 1 and left[3, "x", ""] == 2 and left[None, "z", ""] == 1
    assert left[4, "n", None] == 1 and left[5, "e", ""] == 1 and left[3, "v", "Other. "] == 1
    long = next(r.kept_text for r in out if r.doc_id == 9)
    assert p not in long and long.count("Filler") <= 8
    assert S.document_substrings(docs.where("false")).collect() == []
