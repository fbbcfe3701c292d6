import random
import re

from vecloom.llm import sentence_dedup as S


def say(rng, n, words=5000):
    return " ".join(f"W{rng.randrange(words)}" for _ in range(n))


def brute(docs, passage=50):
    """What is left of each text without the stretches of more than 50 words of earlier documents."""
    seen, left = set(), {}
    for i, text in sorted(docs):
        found = list(re.finditer(r"\S+", text))
        words = [m[0].lower() for m in found]
        stretches = [tuple(words[k : k + passage + 1]) for k in range(len(words) - passage)]
        gone = {k + j for k, x in enumerate(stretches) if x in seen for j in range(passage + 1)}
        starts = [0, *[m.start() for m in found][1:], len(text)]
        left[i] = "".join(text[starts[k] : starts[k + 1]] for k in range(len(found)) if k not in gone)
        seen |= set(stretches)
    return left


def test_passages_of_over_50_words_go_wherever_they_lie(spark):
    rng = random.Random(1)
    shared = [say(rng, n) for n in (51, 51, 60, 90, 300)]
    docs = [(k, f"{say(rng, rng.randint(0, 40))} {shared[k % 5]} {say(rng, rng.randint(0, 40))}") for k in range(40)]
    docs += [(100 + k, f"{say(rng, 9)} {x} {say(rng, 3)}") for k, x in enumerate((say(rng, 50), shared[4][:400].upper(), shared[0].rsplit(" ", 1)[0]))]
    docs += [(200, "AND " * 200), (201, "x " + "and " * 120), (300, shared[3])]
    docs += [(301 + k, f"  {say(rng, 4)}\n {docs[-1 - k][1]}") for k in range(2)]
    out = {r.doc_id: r for r in S.document_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want, texts = brute(docs), dict(docs)
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_removed == len(texts[i]) - len(r.text) == sum(x.end - x.start for x in r.removed) for i, r in out.items())
    assert sum(r.n_removed > 0 for r in out.values()) >= 39 and out[100].n_removed == out[102].n_removed == 0


def test_passages_over_the_ends_of_sentences_and_in_other_scripts(spark):
    rng = random.Random(2)
    passage = f"{say(rng, 25)}. {say(rng, 30)}"  # holds no three whole sentences
    chinese = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(60))
    docs = [(k, f"{say(rng, 5)} {passage} {say(rng, 5)}. {say(rng, 7)}.") for k in range(3)] + [(10 + k, f"{chr(0x5E00 + k) * 4}{chinese}{chr(0x5F00 + k)}") for k in range(2)]
    docs += [(20, None), (None, passage), (2, docs[2][1])]
    out = {}
    for r in S.document_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert out[0] == [docs[0][1]] and all(out[k] == [docs[k][1].replace(passage + " ", "")] * (1 + k // 2) for k in (1, 2))
    assert out[10] == [docs[3][1]] and out[11] == [docs[4][1].replace(chinese, "")] and out[20] == [None] and out[None] == [""]


def test_every_stretch_of_51_words_holds_a_seed():
    rng = random.Random(3)
    for words in (1, 2, 5000):
        for _ in range(200):
            passage = say(rng, 51, words)
            one, two = (set(S.seeds(S.word_hashes(f"{say(rng, rng.randint(0, 40))} {passage} {say(rng, rng.randint(0, 40))}", S._WordHashes()), 50)[0].tolist()) for _ in range(2))
            assert one & two
