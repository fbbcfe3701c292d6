import random
from collections import Counter

from vecloom.llm import decontaminate as D


def similarity(a, b):
    """Weighted Jaccard of the five-word shingles of two whole word lists."""
    one, two = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return sum((one & two).values()) / max(1, sum((one | two).values()))


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(8)
    items = [(i, [f"v{rng.randrange(500)}" for _ in range(rng.choice([30, 50, 80]))]) for i in range(20)]
    docs, want = [], {}
    for k in range(120):
        item, words = rng.choice(items)
        cut = rng.randint(1, len(words) // 3)
        front = rng.randint(0, cut)
        text = words[front : len(words) - (cut - front)]
        if k % 3 == 0:
            text[rng.randrange(len(text))] = "other"
        docs.append((k, " ".join(text)))
        value = similarity(text, words)
        want[k] = ([item], round(value, 6)) if value >= 0.8 else ([], 0.0)
    docs.append((500, " ".join(items[1][1][:-1])))
    want[500] = ([1], round(similarity(items[1][1][:-1], items[1][1]), 6))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = D.document_contamination(frame, bench).collect()
    assert {r.doc_id: (r.item_ids, r.similarity) for r in out} == want
    assert 30 < sum(bool(v[0]) for v in want.values()) < 115
    assert D.keep_clean(frame, bench).count() == sum(not v[0] for v in want.values())
    assert all(m.n_words == len(t.split()) for r, t in zip(D.with_matches(frame, bench).orderBy("doc_id").collect(), [t for _, t in sorted(docs)]) for m in r.matches)
