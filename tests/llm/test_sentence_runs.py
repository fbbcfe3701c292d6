import random

from vecloom.llm import sentence_dedup as S


def say(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_passages_are_covered_to_their_end(spark):
    rng = random.Random(3)
    passage = " ".join(say(rng, n) + "." for n in (12, 12, 12, 12, 4, 4, 4))
    docs = [(k, f"{say(rng, 9)}. {passage} {say(rng, 30)}. {say(rng, 12)}.") for k in range(4)]
    out = {r.doc_id: r.kept_text for r in S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1]
    assert all(out[k] == docs[k][1].replace(passage + " ", "") for k in (1, 2, 3))


def test_every_passage_of_51_words_without_marks_holds_a_run():
    rng = random.Random(4)
    for words in (2, 5, 5000):
        for _ in range(700):
            passage = " ".join(f"v{rng.randrange(words)}" for _ in range(51))
            one, two = (set(map(tuple, S.runs(S.sentences(f"{say(rng, rng.randint(0, 40))} {passage} {say(rng, rng.randint(0, 40))}", 12))[0].tolist())) for _ in range(2))
            assert one & two


def test_only_whole_sentences_go_and_long_ones_count_like_short_ones(spark):
    rng = random.Random(5)
    for n in (11, 12, 13, 40):
        shared = [say(rng, n).capitalize() + "." for _ in range(3)]
        part = " ".join(say(rng, 60).split()[:55])
        docs = [(k, f"{say(rng, 5)}. {' '.join(shared)} {say(rng, 4)} {part} {say(rng, 4)}. {say(rng, 6)}.") for k in range(3)]
        out = {r.doc_id: r for r in S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        for k in (1, 2):
            assert out[k].kept_text == docs[k][1].replace(" ".join(shared) + " ", "") and part in out[k].kept_text


def test_sentence_marks_of_other_scripts(spark):
    chinese = "".join("".join(chr(0x4E00 + (7 * k * k + 31 * j) % 900) for j in range(9 + k % 4)) + "\u3002\uff01\uff1f"[k % 3] for k in range(8))
    hindi = " ".join(f"\u0935\u093e\u0915\u094d\u092f {k} \u092f\u0939\u093e\u0901 \u0939\u0948 \u0914\u0930 \u0930\u0939\u0924\u093e {3 * k}\u0964" for k in range(5))
    docs = [(1, f"\u524d\u3002{chinese}"), (2, f"\u5f8c\u5f8c\u3002{chinese}\u672b\u3002"), (3, f"Eins. {hindi}"), (4, f"Zwei hier. {hindi}"), (5, 'He said "no." Then he left. ' * 1)]
    assert len(S.sentences(docs[1][1])) == 10
    out = {r.doc_id: r.kept_text for r in S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1] == docs[0][1] and out[2] == "\u5f8c\u5f8c\u3002\u672b\u3002" and out[4] == "Zwei hier. " and out[5] == docs[4][1]
