from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from vecloom.llm import filter_audit as A

SPACE = " \t\n\x0b\x0c\r"


def fails(doc, docs):
    ident, text, _ = doc
    text = text or ""
    for c in SPACE:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    whole = doc[1] or ""
    out = ""
    out += "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in whole) > 2 * len(whole) else ""
    out += "D" if any(c in "#$%&*|" for c in whole) else ""
    out += "E" if ident is not None and any(o[0] is not None and o[0] < ident and (o[1] or "") == whole for o in docs) else ""
    return out


def replayed(docs, good, toxic):
    parts = defaultdict(list)
    for d in docs:
        parts[d[2] or ""].append((d[0], fails(d, docs)))
    rows, taken = {}, defaultdict(int)
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                rows[part, order, step] = [
                    len(left), len(gone), sum(f in m[1] for m in members) - len(gone), sum(m[1] == f for m in members),
                    sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)]
                taken[part, f] += len(gone)
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def as_rows(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in frame.collect()}


def corpus():
    long = " ".join(f"w{i}" for i in range(230))
    texts = [long, long + " #", "w " * 300, "ABC def", None, "", "x y", long.upper(), "a|b", long + " Z" * 30, "w\x0bw\x0c" * 150, long + " é" * 4]
    docs = [(i, texts[i % len(texts)], ["a", None, "b", ""][i % 4]) for i in range(60)]
    docs += [(None, long, "a"), (None, "ABC def", None), (3, "ABC def", "b"), (3, "ABC def", "a"), (3, "other", "a"), (3, "other", "a")]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 50, 2)] + [(2, 0, None), (3, None, 1), (3, 1, 0), (None, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    return docs, labels, good, toxic


def test_every_order_against_a_replay(spark):
    docs, labels, good, toxic = corpus()
    frame = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, source string, part int, MASK string").repartition(6)
    got = as_rows(A.document_filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == replayed(docs, good, toxic)


def test_sql_gives_the_same(spark):
    import duckdb
    import pyarrow as pa

    docs, labels, *_ = corpus()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "source": [d[2] for d in docs]}))
    con.register("labels", pa.table({n: pa.array([x[k] for x in labels], pa.int64()) for k, n in enumerate(("doc_id", "quality", "toxic"))}))
    rel = con.sql(A.AUDIT_SQL)
    want = {tuple(r[rel.columns.index(c)] for c in ("part", "filter_order", "step")): tuple(r[rel.columns.index(c)] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rel.fetchall()}
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert as_rows(A.document_filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == want


def test_other_filters_without_copies_or_labels(spark):
    docs = spark.createDataFrame([(i, f"{'x' * (i % 3)}{'y' * (i % 2)}", "s") for i in range(12)], "doc_id long, text string, source string")
    counts = A.mask_counts(docs, {"X": F.col("text").contains("x"), "Y": F.col("text").contains("y")}, copies=False)
    table = A.survivors(counts, 2, ["n"])
    assert table.first()["n"] == [12, 4, 6, 2]
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in A.order_steps(table, "XY", []).collect()}
    assert rows == {("XY", 1): (4, 8, 12), ("XY", 2): (2, 2, 8), ("YX", 1): (6, 6, 8), ("YX", 2): (2, 4, 12)}


def test_a_text_that_fills_most_of_the_table_and_empty_tables(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = as_rows(A.document_filter_audit(docs, none))
    assert len(got) == 1200 and sum(got[s, "EABCD", 1][1] for s in ("s0", "s1")) == docs.where("text = 'same'").count() - 1
    assert as_rows(A.document_filter_audit(docs.limit(0), none)) == {}
