import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vecloom.llm import fill_in_middle as M

ALPHABET = list("ab  c\t\n\x0b\x0c\r") + ["é", "中", "😀", " ", " ", "<P", "<M>", "\x1c", "\x85", "\x00"]


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def expected(ident, text):
    """The rule in plain words, with another way to cut."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", text)
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_query_against_the_rule(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = corpus() + [(900, None), (901, ""), (902, "word " * 60_000), (902, "word"), (903, "no<S>pe " * 40), (None, "null id and more words " * 5)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, FIM string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in M.document_fim(docs).collect()), key=key)
    want = []
    for ident, text in rows:
        *head, output = expected(ident, text)
        want.append((ident, *head, sha(output), sha(text or "")))
    assert got == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_written_texts_read_back():
    for ident, text in corpus(2000, 9):
        n, form, a, b, output = M.arranged(text, str(ident), rate=100, spm_rate=50)
        assert M.read_back(output, form) == text
        if form != "plain":
            ends = M.unit_ends(text)
            assert n == len(ends) and ends[-1] == len(text) and ends.itemsize == 4


def test_columns_pass_names_clash_and_empty_tables(spark):
    frame = spark.createDataFrame([(7, "a b c d", {"k": 1})], "doc_id long, text string, `ex.tra` map<string,int>")
    row = M.fill_in_middle(frame, rate=100).first()
    assert row["ex.tra"] == {"k": 1} and row.fim.output == expected(7, "a b c d")[-1] or row.fim.form != "plain"
    with pytest.raises(ValueError):
        M.fill_in_middle(frame.withColumn("Fim", F.lit(1)))
    assert M.document_fim(frame.limit(0)).collect() == []


def test_sql_gives_the_same(spark):
    import duckdb
    import pyarrow as pa

    rows = [(i, t.replace("\x00", "")) for i, t in corpus(300, 21)] + [(None, "some words here"), (5000, None)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    rel = con.sql(M.FIM_SQL)
    names = M.document_fim(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((tuple(r[rel.columns.index(c)] for c in names.columns) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in names.collect()), key=str) == want
