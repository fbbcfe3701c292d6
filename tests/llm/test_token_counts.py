import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm import token_counts as T

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = list("aab  eLl'rsve't\n\t!.12") + ["é", "ß", "中", "😀", " ", "　", "<|endoftext|>", "<|end", "\x1c", "\x85", "'ll", "'re", " the", "ing", "\r", "٣", "़", "_"]


def size(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_every_prefix_is_what_the_library_gives():
    counter = T.counter(*T._arguments(None, None))
    for text in texts():
        assert list(counter.prefix_counts(text)) == [size(text[:i]) for i in range(len(text) + 1)], repr(text)
        assert counter.count(text) == size(text)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    counter = T.PrefixCounter(*T._arguments(None, None))
    assert [counter.count(x) for x in texts(100)] == [size(x) for x in texts(100)]


def test_query_on_whole_texts(spark):
    rows = [(i, x) for i, x in enumerate(texts(60))] + [(900, None), (901, ""), (902, "word " * 30_000), (902, "word"), (None, "=" * 5000)]
    docs = spark.createDataFrame([(i, x, 1, "n") for i, x in rows], "doc_id long, text string, n_tokens int, N_BYTES string")
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in T.document_token_counts(docs).collect()))
    want = sorted((i or -1, len((x or "").encode()), size(x or ""), size(x or "") > 1024) for i, x in rows)
    assert got == want


def test_truncation_and_budget_questions(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts(40, 5))] + [(99, None)], "doc_id long, text string")
    counted = T.with_prefix_counts(docs).withColumn("fit", T.longest_within(F.col("prefix_counts"), 3)).withColumn("third", T.count_at(F.col("prefix_counts"), 3))
    for r in counted.withColumn("cut", T.truncated(F.col("text"), F.col("prefix_counts"), 3)).collect():
        text = r.text or ""
        assert r.fit == max(i for i in range(len(text) + 1) if size(text[:i]) <= 3)
        assert r.third == size(text[:3])
        assert r.cut == (None if r.text is None else text[: r.fit])


def test_empty_table_and_clash(spark):
    assert T.document_token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        T.with_token_counts(spark.createDataFrame([], "text string, N_Tokens int"))
    out = T.with_token_counts(spark.createDataFrame([("a b", {"k": 1})], "text string, extra map<string,int>"))
    assert [tuple(r) for r in out.collect()] == [("a b", {"k": 1}, 2)]


def test_what_fits_in_a_limit_against_every_prefix():
    counter = T.counter(*T._arguments(None, None))
    rng = random.Random(8)
    for k in range(150):
        text = "".join(texts(rng.randint(1, 9), 100 + k))
        if k % 3:
            text = text.replace("<|endoftext|>", "<|")
        counts = [size(text[:i]) for i in range(len(text) + 1)]
        for limit in {0, 1, 7, counts[-1] // 2, counts[-1] - 1, counts[-1], counts[-1] + 1}:
            if limit >= 0:
                want = max(i for i, n in enumerate(counts) if n <= limit)
                assert counter.measure(text, limit) == (counts[-1], want), (text, limit)


def test_query_shows_what_fits(spark):
    text = "Some words, and it'll go on  " * 400
    out = {r.doc_id: r for r in T.document_token_counts(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")).collect()}
    assert out[2].within_limit == 5 and out[3].within_limit == 0 and out[1].over_limit
    assert size(text[: out[1].within_limit]) <= 1024 < size(text[: out[1].within_limit + 1])
