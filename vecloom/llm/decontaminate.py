"""Benchmark decontamination with SimHash over item-sized windows.

Every benchmark item becomes a SimHash of its 5-word shingles.  Windows as long as an item (in words)
slide over a document; a window's SimHash is looked up in a multi-index table of the items of that
length (the fingerprint is cut into ``BLOCKS`` blocks; for every item each block's whole Hamming ball of
radius ``RADIUS // BLOCKS`` is stored, so by the pigeonhole principle every item within ``RADIUS`` bits
is found), and each candidate is verified by the exact weighted Jaccard similarity of the two shingle
multisets, 0.8 or more.  A text shorter than an item is itself the one window for it.

A window can only reach 0.8 if at least 8/9 of as many shingles as it has are the item's, so windows
with fewer shingles of any benchmark item of that length are not fingerprinted, and of a shorter text
as many as 4/9 of its own and the item's shingles together; this drops no match.

Scale: one narrow pass over the documents, no shuffle; what is broadcast is the benchmark, in blocks
of at most ``max_items`` items and ``max_bytes`` bytes whose number follows the benchmark's counted
size.  With one block the pass carries the documents' own columns; with more, each block's pass
yields only the rows it matches, which are merged by row.

Defined results: words are runs of letters, digits and underscores, lower-cased; items or documents of
fewer than five words use their whole word sequence as the one shingle; null, empty or wordless texts
and items match nothing; an item without an id is matched like any other and named by null; identifiers
keep the type they have; texts are never cut; repeated rows each give a row; an empty benchmark or an
empty table gives no matches or an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.llm.tables import free_name, mapped, quoted
from vecloom.plans.durable import materialize

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that every bit of a shingle's code counts."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of every run of ``size`` word numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1))
    return code


def simhash(codes: np.ndarray) -> int:
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * bits > len(codes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller over sum of the larger multiplicities (weighted Jaccard)."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


@lru_cache(maxsize=4)
def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


class WindowIndex:
    """Items of one length in words: their shingles, fingerprints and multi-index table."""

    def __init__(self, length: int, radius: int, blocks: int):
        self.length, self.shingle, self.radius = length, min(SHINGLE, length), radius
        self.count = length - self.shingle + 1
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        self.parts = [(k, a, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        self.ball = radius // blocks
        self.items: list[tuple[int, int, Counter]] = []
        self.table: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.known = np.zeros(0, np.uint64)

    def add(self, item_id: int, codes: np.ndarray) -> None:
        at, print_ = len(self.items), simhash(codes)
        self.items.append((item_id, print_, Counter(codes.tolist())))
        for part, shift, width in self.parts:
            value = print_ >> shift & ((1 << width) - 1)
            for mask in _masks(width, self.ball):
                self.table[part, value ^ mask].append(at)

    def seal(self) -> None:
        self.known = np.unique(np.array([c for _, _, s in self.items for c in s], dtype=np.uint64))

    def within_radius(self, print_: int) -> set[int]:
        near: set[int] = set()
        for part, shift, width in self.parts:
            near.update(self.table.get((part, print_ >> shift & ((1 << width) - 1)), ()))
        return {k for k in near if (self.items[k][1] ^ print_).bit_count() <= self.radius}

    def matches(self, codes: np.ndarray, similarity: float):
        """(item id, first word, similarity) of each window that verifies."""
        size = min(self.count, len(codes))  # a text shorter than the item is its own window
        if size < similarity * self.count - 1e-9:
            return
        at = np.searchsorted(self.known, codes)
        at[at == len(self.known)] = 0
        hit = (self.known[at] == codes).astype(np.int64)
        if not hit.any():
            return
        run = np.concatenate([[0], np.cumsum(hit)])
        held = run[size:] - run[:-size]
        least = int(np.ceil(similarity / (1 + similarity) * (size + self.count) - 1e-9))
        for start in np.nonzero(held >= least)[0]:
            window = codes[start : start + size]
            near = self.within_radius(simhash(window))
            if near:
                own = Counter(window.tolist())
                for k in near:
                    value = weighted_similarity(own, self.items[k][2])
                    if value >= similarity:
                        yield self.items[k][0], int(start), value


class Benchmark:
    """The items of one broadcast block."""

    def __init__(self, items, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS):
        self.similarity = similarity
        self.number: dict[str, int] = {}
        self.by_length: dict[int, WindowIndex] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words], dtype=np.int64)
            index = self.by_length.get(len(words))
            if index is None:
                index = self.by_length[len(words)] = WindowIndex(len(words), radius, blocks)
            index.add(item_id, shingle_codes(ids, index.shingle))
        for index in self.by_length.values():
            index.seal()
        self.shingles = sorted({i.shingle for i in self.by_length.values()})
        self.known = {s: np.unique(np.concatenate([i.known for i in self.by_length.values() if i.shingle == s])) for s in self.shingles}

    def find(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """item id -> (best similarity, first word, words) over all windows of the text."""
        if not text or not self.number:
            return {}
        number = self.number.get
        ids = np.array([number(w, -1) for w in WORD.findall(text.lower())], dtype=np.int64)
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.shingles:
            # only stretches of benchmark words can hold a shingle of an item
            inside = np.concatenate([[0], np.cumsum(ids >= 0)])
            if len(ids) < size or not ((inside[size:] - inside[:-size]) == size).any():
                continue
            codes = shingle_codes(ids, size)
            known = self.known[size]
            at = np.searchsorted(known, codes)
            at[at == len(known)] = 0
            if not (known[at] == codes).any():
                continue
            for index in self.by_length.values():
                if index.shingle == size:
                    for item, start, value in index.matches(codes, self.similarity):
                        if value > best.get(item, (0.0,))[0]:
                            best[item] = (value, start, min(index.length, len(ids)))
        return best


def benchmark_blocks(benchmark: DataFrame, max_items: int = 20_000, max_bytes: int = 32 << 20, id_col="item_id", text_col="text") -> list[list[tuple]]:
    """How many blocks the counted size of the benchmark asks for, and a function reading each."""
    slim = benchmark.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).cast("string").alias("t")).where("t is not null").distinct()
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    count = max(1, -(-size["n"] // max_items), -(-(size["b"] or 0) // max_bytes))
    return [slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k) for k in range(count)]


def _found_type(ident: T.DataType) -> tuple[T.StructType, pa.DataType]:
    """The type of one match, for Spark and for Arrow."""
    fields = [("item_id", ident), ("similarity", T.DoubleType()), ("first_word", T.IntegerType()), ("n_words", T.IntegerType())]
    return T.StructType([T.StructField(n, k) for n, k in fields]), pa.list_(pa.struct([(n, to_arrow_type(k)) for n, k in fields]))


def _pass(rows: DataFrame, items: DataFrame, name: str, similarity: float) -> DataFrame:
    """Replaces the last column, the text, by the matches with one block of the benchmark."""
    found = Benchmark([(r["i"], r["t"]) for r in items.collect()], similarity)
    shared = rows.sparkSession.sparkContext.broadcast(found)
    at = len(rows.columns) - 1
    kind, arrow = _found_type(items.schema["i"].dataType)
    schema = T.StructType([*rows.schema.fields[:at], T.StructField(name, T.ArrayType(kind))])

    def scan(batches):
        known = shared.value
        for batch in batches:
            made = []
            for x in batch.column(at):
                best = known.find(x.as_py())
                made.append([{"item_id": i, "similarity": v[0], "first_word": v[1], "n_words": v[2]} for i, v in sorted(best.items(), key=lambda m: (m[0] is None, m[0]))])
            fields = [*list(batch.schema)[:at], pa.field(name, arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(made, arrow)], schema=pa.schema(fields))

    return mapped(rows, scan, schema)


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "matches", similarity: float = SIMILARITY, keep: list[str] | None = None, **limits) -> DataFrame:
    """The columns ``keep`` (all by default) and an array of matched items, empty where clean."""
    keep = docs.columns if keep is None else keep
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the input already has a column named {name}")
    text = F.col(quoted(text_col)).cast("string")
    blocks = benchmark_blocks(benchmark, **limits)
    rows = docs.select(*[F.col(quoted(c)) for c in keep], text.alias(free_name(docs, "text")))
    if len(blocks) == 1:
        return _pass(rows, blocks[0], name, similarity)
    key = F.sha2(text, 256)
    texts = docs.select(key.alias("key"), text.alias("text"))
    partial = None
    for block in blocks:
        some = materialize(_pass(texts, block, "found", similarity).where(F.size("found") > 0), "matches")
        partial = some if partial is None else partial.unionByName(some)
    merged = partial.select("key", F.explode("found").alias("f")).groupBy("key").agg(F.sort_array(F.collect_set("f")).alias(name))
    h = free_name(docs, "key")
    joined = docs.select(*[F.col(quoted(c)) for c in keep], key.alias(h)).join(merged.withColumnRenamed("key", h), h, "left")
    return joined.select(*[F.col(quoted(c)) for c in keep], F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)).alias(name))


def document_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and the best similarity of every document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").alias("n_items"),
        F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)), 6).alias("similarity"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    name = free_name(docs, "matches")
    return with_matches(docs, benchmark, name=name).where(F.size(name) == 0).select(*[F.col(quoted(c)) for c in docs.columns])
