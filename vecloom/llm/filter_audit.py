"""How quality filters interact: what every order of them keeps, removes and finds already gone.

Each document gets one bit a filter it fails, so all that is needed of the corpus is how many documents
of a part have each mask.  The subset-zeta transform turns these counts into the survivors of *every*
subset of filters at once (``survivors[S]`` = documents failing nothing in ``S``), by one addition a
filter and subset.  A step of an order is then the difference between two neighbouring subsets, and so
are the labelled documents it costs; a filter's Shapley value is the same differences, weighted by the
number of orders they occur in.  Nothing is filtered twice and no order is replayed.

Scale: texts are read once by a narrow pass that keeps a digest and a mask.  Equal texts are counted by
(id, digest), then by digest and part, both with map-side combining, so a text that makes up a third of
the table arrives in each task as a few counts; the least id of a text comes from the same counts.  Rows
without an id go round the join with the labels.  What is left has one row a part.

Defined results: a null text is the empty text; a null part is the part "" (as is an empty one); rows
without an id never count as copies or as the original of one, and have no labels; rows that repeat an
id with the same text are neither copies of each other nor merged; of several label rows with one id any
0/1 that is 1 counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.tables import quoted

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """What fails a document by its text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, filters: dict[str, Column], copies: bool, labels: dict[str, Column] | None = None, label_rows: DataFrame | None = None, part: str = "source") -> DataFrame:
    """``part``, ``mask`` and the counts ``n`` and one a label: documents by the set of filters they fail.

    ``docs`` has doc_id and text.  Bit k is the k-th of ``filters`` (conditions over ``text``); with
    ``copies`` one more bit marks texts that a smaller doc_id has too.  ``labels`` are conditions over
    ``label_rows``, which has doc_id.
    """
    labels = labels or {}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(filters.values())]
    digest = F.unhex(F.sha2("text", 256)) if copies else F.lit(b"")
    masked = slim.select("id", "part", digest.alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    counted = masked.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))

    flags = list(labels)
    unlabelled = [F.lit(0).alias(f"flag{k}") for k in range(len(flags))]
    if labels and label_rows is not None:
        given = label_rows.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
        given = given.agg(*[F.max(F.when(on, 1).otherwise(0)).alias(f"flag{k}") for k, on in enumerate(labels.values())])
        known = counted.where(F.col("id").isNotNull()).join(given, "id", "left").fillna(0, [f"flag{k}" for k in range(len(flags))])
        counted = known.unionByName(counted.where(F.col("id").isNull()).select("*", *unlabelled))
    else:
        counted = counted.select("*", *unlabelled)
    keys = ["part", "mask", *[f"flag{k}" for k in range(len(flags))]]
    if copies:
        # min over (id, n) also says how many rows of the group have its least id: ids are distinct within it.
        lone = counted.where(F.col("id").isNull()).select(*keys, "n")
        grouped = counted.where(F.col("id").isNotNull()).groupBy("digest", *keys).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
        least = grouped.groupBy("digest").agg(F.min("first.id").alias("least"))
        originals = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
        split = grouped.join(least, "digest").select(*keys, originals.alias("originals"), (F.col("n") - originals).alias("again"))
        split = split.groupBy(*keys).agg(F.sum("originals").alias("originals"), F.sum("again").alias("again"))
        copy_bit = 1 << len(filters)
        both = F.explode(F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), F.col("again").alias("n")))).alias("side")
        sides = split.select("part", *keys[2:], both).select("part", "side.mask", *keys[2:], "side.n")
        counted = sides.unionByName(lone)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"flag{k}")).alias(name) for k, name in enumerate(flags)])


def survivors(counts: DataFrame, filters: int, measures: list[str]) -> DataFrame:
    """One row a part: each measure as an array over all subsets S, of what fails nothing in S."""
    entries = F.collect_list(F.struct(F.col("mask"), F.struct(*measures)))  # at most one a mask
    table = counts.groupBy("part").agg(F.map_from_entries(entries).alias("cells"))
    masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return zeta(table.select("part", *[_filled(masks, c).alias(c) for c in measures]), measures, filters)


def _filled(masks: Column, measure: str) -> Column:
    return F.transform(masks, lambda m: F.coalesce(F.col("cells")[m][measure], F.lit(0).cast("long")))


def zeta(table: DataFrame, measures: list[str], filters: int) -> DataFrame:
    """The subset-zeta transform of arrays over masks, read at complements: entry S sums the cells whose
    mask is disjoint from S.

    After bit k, entry m holds all masks that agree with m above bit k and are subsets of it in the bits up
    to k: one addition an entry and bit.  Reversing the array turns the complement of S into entry S.
    """

    def step(column: Column, bit: int) -> Column:
        cells = [F.get(column, F.lit(m)) for m in range(1 << filters)]
        return F.array(*[cell + cells[m ^ bit] if m & bit else cell for m, cell in enumerate(cells)])

    for k in range(filters):
        table = table.select("part", *[step(F.col(c), 1 << k).alias(c) for c in measures])
    return table.select("part", *[F.reverse(c).alias(c) for c in measures])


def order_steps(table: DataFrame, letters: str, labels: list[str], measure: str = "n") -> DataFrame:
    """One row a part, order and step from the survivors of all subsets: every column a difference of two."""
    orders = list(permutations(range(len(letters))))
    every = (1 << len(letters)) - 1
    steps = len(letters)
    names, before, which = [], [], []
    for order in orders:
        done = 0
        for f in order:
            names.append("".join(letters[k] for k in order))
            before.append(done)
            which.append(f)
            done |= 1 << f
    left = lambda column, subset: F.get(F.col(column), subset)
    shapley = []
    for f in range(steps):
        others = [s for s in range(every + 1) if not s >> f & 1]
        weight = {s: factorial(s.bit_count()) * factorial(steps - 1 - s.bit_count()) for s in others}
        shapley.append(sum((weight[s] * (left(measure, F.lit(s)) - left(measure, F.lit(s | 1 << f))) for s in others), F.lit(0)))
    by_filter = table.withColumn("shapley", F.array(*shapley))
    rows = by_filter.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    rows = rows.withColumns({"f": F.get(F.lit(which), F.col("k")), "was": F.get(F.lit(before), F.col("k"))})
    bit = F.call_function("shiftleft", F.lit(1), F.col("f"))
    rows = rows.withColumns({"bit": bit, "now": F.col("was").bitwiseOR(bit)})
    removed = left(measure, F.col("was")) - left(measure, F.col("now"))
    failing = left(measure, F.lit(0)) - left(measure, F.col("bit"))
    alone = left(measure, F.lit(every).bitwiseXOR(F.col("bit"))) - left(measure, F.lit(every))
    return rows.select(
        "part",
        F.get(F.lit(names), F.col("k")).alias("filter_order"),
        (F.col("k") % steps + 1).cast("int").alias("step"),
        left(measure, F.col("now")).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        alone.alias("unique_fails"),
        *[(left(c, F.col("was")) - left(c, F.col("now"))).alias(f"{c}_lost") for c in labels],
        F.get(F.col("shapley"), F.col("f")).alias("shapley"),
    )


def document_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of five filters over whole documents, by source, with the good and toxic documents lost."""
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    counts = mask_counts(docs, text_filters(F.col("text")), copies=True, labels=marks, label_rows=labels)
    return order_steps(survivors(counts, len(LETTERS), ["n", *marks]), LETTERS, list(marks))


#: The same rows without the transform: every order is replayed over the documents' masks.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(words) < 200 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN least < w.doc_id THEN 'E' END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, k AS step, filter_order[k] AS letter, filter_order[1:k - 1] AS earlier FROM o, range(1, 6) r(k)),
x AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, earlier <> '' AND regexp_matches(fails, '[' || earlier || '.]') AS gone, length(fails) AS many
  FROM g, s),
t AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM t
"""
