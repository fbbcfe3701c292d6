import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecloom.llm import packing as P

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = list("aab  eLl'rsve't\n\t!.12") + ["é", "中", "😀", "　", "<|endoftext|>", "<|end", "'ll", " the", "ing", "\r", "٣", "_"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(int(most ** rng.random()))) for _ in range(n)]


def padding(lengths, width=1024):
    return sum(0 if n & (n - 1) == 0 else width - n for n in lengths)


def check(rows, docs, width=1024):
    """Every id of every document in exactly one piece, sequences within the width and without gaps."""
    sequences, found = defaultdict(list), defaultdict(list)
    for r in rows:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id))
        found[r.doc_id].append((r.start, got, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= width
        assert max(Counter(d for _, _, d in pieces).values()) == 1
    for ident, text in docs:
        whole = [k for _, part, _ in sorted(found[ident], key=lambda x: x[0]) for k in part]
        assert whole == ids(text) and {t for *_, t in found[ident]} == {len(whole)}
    assert len(found) == len(docs)
    return [sum(n for _, n, _ in s) for s in sequences.values()]


def test_ids_are_those_of_the_library():
    encode = P.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert encode.fast is not None
    for text in [*texts(500, 60), "", " " * 5000, "=" * 3000, "a" * 20000, "<|endoftext|>" * 3, " \n" * 400 + "x"]:
        assert encode(text).tolist() == ids(text)[:-1], text[:50]


def test_texts_the_fast_path_gives_up_on(monkeypatch):
    encode = P.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

    class Panic:
        def encode_to_numpy(self, *_, **__):
            raise BaseException("panic")

    encode.fast = Panic()
    assert encode("it's  fine").tolist() == ids("it's  fine")[:-1]
    encode.fast = None
    assert encode("it's  fine").tolist() == ids("it's  fine")[:-1]


def test_every_token_once_and_little_padding(spark):
    docs = list(enumerate(texts(700, 9000))) + [(9000, None), (9001, ""), (9002, "word " * 1023), (9003, "word " * 40_000), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    lengths = check(P.pack(frame).collect(), docs)
    assert padding(lengths) < 0.01 * sum(lengths)


def test_small_windows_many_merges_and_the_digest(spark):
    docs = list(enumerate(texts(300, 400, 5)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    rows = P.pack(frame, width=64, open_windows=4, least_piece=3, group_windows=5).collect()
    lengths = check(rows, docs, 64)
    assert all(n & (n - 1) == 0 or n > 64 - 3 for n in lengths)
    for r in P.document_packing(frame).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids(docs[r.doc_id][1])[r.start : r.start + r.length], "<u4").tobytes())


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    rows = P.pack(spark.createDataFrame([(1, "same", 5, "x")] * 40, "doc_id long, text string, length int, OFFSET string")).collect()
    assert len(rows) == 40 and len({(r.sequence_id, r.offset) for r in rows}) == 40
    assert P.document_packing(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, "a")], "start long, text string"), id_col="start")
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), open_windows=0)


def test_window_rule_by_hand():
    closed = []
    windows = P.Windows(10, 2, 2, lambda pieces: closed.append([(p[0], p[1], len(p[2])) for p in pieces]))
    put = lambda name, n: windows.place([(name, 0, np.zeros(n, "<u4"), n)], n)
    put("a", 6)
    put("b", 7)  # does not fit beside a: a second window
    put("c", 3)  # best fit is b's window, which is then full
    assert closed == [[("b", 0, 7), ("c", 0, 3)]]
    put("d", 9)
    put("e", 5)  # fits nowhere and d's window has room for one only: emitted as it is
    assert closed[1:] == [[("d", 0, 9)]]
    put("f", 7)  # a's window is fullest: four of f fill it, three go beside e
    assert closed[2:] == [[("a", 0, 6), ("f", 0, 4)]]
    put("g", 23)  # two windows of its own, three at the end
    assert closed[3:] == [[("g", 0, 10)], [("g", 10, 10)]]
    windows.finish()
    assert closed[5:] == [[("e", 0, 5), ("f", 4, 3), ("g", 20, 2)], [("g", 22, 1)]]


def test_sequences_are_padded_but_for_powers_of_two(spark):
    docs = list(enumerate(texts(60, 500, 8)))
    pieces = P.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), width=64, open_windows=3)
    by_sequence = defaultdict(list)
    for r in pieces.collect():
        by_sequence[r.sequence_id].append((r.offset, r.ids))
    out = P.sequences(pieces, 64).collect()
    assert len(out) == len(by_sequence)
    for r in out:
        ids_ = b"".join(x for _, x in sorted(by_sequence[r.sequence_id]))
        n = len(ids_) // 4
        assert r.length == n == sum(r.segments)
        assert r.ids == (ids_ if n & (n - 1) == 0 else ids_ + bytes(4 * (64 - n)))
