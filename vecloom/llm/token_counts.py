"""Exact BPE token counts at every prefix by dynamic programming.

A byte-level BPE splits a text into pieces (words with their leading space, runs of space or
punctuation) and merges within each.  Within a piece, the last token of the encoding of every prefix
is unique: it is the one token that ends there and forms a *stable pair* with the last token of what
lies before it (encoding the two tokens' bytes gives back the two).  So one pass over a piece's bytes
gives the count at every prefix, ``count[i] = count[i - len(token)] + 1``, and chaining the pieces
gives it for the whole text: truncation and budget questions become look-ups, nothing is encoded again.

Scale: a narrow Arrow map, no shuffle.  Each worker keeps the prefix tables of pieces it has seen in
two generations of at most ``CACHE`` entries, so memory is bounded whatever the vocabulary of the
corpus; the tokenizer is read once per worker process.

Defined results: a null text counts as empty (0 bytes, 0 tokens); texts are never cut; special
strings inside a text are single tokens, as the library's default has it; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.tables import mapped, quoted

LIMIT = 1024
CACHE = 400_000
LONGEST_KEPT = 64  # longer pieces are computed each time they occur


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Totals(dict):
    """The last entry of each piece's prefix table, in two generations of at most CACHE pieces."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter, self.old = counter, {}

    def __missing__(self, piece: str) -> int:
        total = self.old.get(piece)
        if total is None:
            total = int(self.counter.piece_table(piece.encode("utf-8"))[-1])
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = total
        return total


class PrefixCounter:
    """Prefix tables of one byte-level BPE vocabulary (a ``tokenizers`` JSON file)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        tokens = {bytes([b]) for b in range(256)}
        for k, pair in enumerate(model["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[left, right] = k
            tokens.add(left + right)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokens = {t for t in tokens if len(t) == 1 or self.merged(t) == [t]}
        self.longest = max(map(len, self.tokens))
        self.split = regex.compile(pattern)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.blank = regex.compile(r"\s+")
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}
        self.totals = _Totals(self)

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: lowest-ranked adjacent pair first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.rank.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:]))]
            rank, k = min(ranked)
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def is_stable(self, left: bytes, right: bytes) -> bool:
        if len(self.stable) > 4 * CACHE:
            self.stable.clear()
        self.stable[left, right] = stable = self.merged(left + right) == [left, right]
        return stable

    def piece_table(self, piece: bytes) -> np.ndarray:
        """Token counts of the prefixes of 0 .. len(piece) bytes of one piece."""
        n = len(piece)
        counts = [0] * (n + 1)
        last: list[bytes] = [b""] * (n + 1)
        tokens, known, longest = self.tokens, self.stable, self.longest
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = piece[start:end]
                if token in tokens:
                    if start:
                        stable = known.get((last[start], token))
                        if not (self.is_stable(last[start], token) if stable is None else stable):
                            continue
                    last[end] = token
                    counts[end] = counts[start] + 1
                    break
        return np.array(counts, dtype=np.int32)

    def table(self, piece: str) -> np.ndarray:
        found = self.young.get(piece)
        if found is not None:
            return found
        found = self.old.get(piece)
        if found is None:
            found = self.piece_table(piece.encode("utf-8"))
            if len(piece) > LONGEST_KEPT:
                return found
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def segments(self, text: str):
        """(text, is_special) runs: special strings stand alone."""
        if self.at_special is None:
            yield text, False
            return
        at = 0
        for m in self.at_special.finditer(text):
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of its chained prefix tables."""
        total, known, split = 0, self.totals.__getitem__, self.split.findall
        for run, special in self.segments(text or ""):
            total += 1 if special else sum(map(known, split(run)))
        return total

    def measure(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens of the whole text, most leading characters whose tokens are within ``limit``).

        The second is looked up in the prefix tables of the pieces round the one where the running count
        passes the limit: counts of prefixes that end there differ from it by those pieces alone.
        """
        text = text or ""
        if self.at_special is not None and self.at_special.search(text):
            counts = self.prefix_counts(text)
            return int(counts[-1]), int(np.nonzero(counts <= limit)[0][-1])
        pieces = self.split.findall(text)
        totals = list(accumulate(map(self.totals.__getitem__, pieces), initial=0))
        if totals[-1] <= limit:
            return totals[-1], len(text)
        past = bisect_right(totals, limit)
        first, last = max(0, past - 5), past + 4
        start = sum(map(len, pieces[:first]))
        counts = totals[first] + self.prefix_counts("".join(pieces[first:last]))
        return totals[-1], start + int(np.nonzero(counts <= limit)[0][-1])

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Counts at 0 .. len(text) characters; entry i is exactly the count of ``text[:i]`` alone.

        A cut changes how the split falls in three places only, each settled from the start of the
        last piece: after a whole run of spaces (one piece at a text's end, two before a word),
        within three-letter contractions, and within special strings (ordinary text once cut).
        """
        text = text or ""
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        at = base = 0
        last_at = last_base = 0
        for run, special in self.segments(text):
            if special:
                for k in range(at + 1, at + len(run)):
                    counts[k] = last_base + self.count(text[last_at:k])
                at, base = at + len(run), base + 1
                counts[at] = base
                last_at, last_base = at, base
                continue
            for piece in self.split.findall(run):
                end, table = at + len(piece), self.table(piece)
                counts[at + 1 : end + 1] = base + table[np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])]
                if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
                    counts[at + 2] = base + self.count(piece[0]) + self.count(piece[1])
                if self.blank.fullmatch(text, last_at, at) and self.blank.match(text, at):
                    counts[at + 1] = last_base + int(self.table(text[last_at : at + 1])[-1])
                last_at, last_base = at, base
                at, base = end, base + int(table[-1])
        return counts


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def _arguments(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or default_vocabulary(), pattern or public_tokenizers.PATTERN


def with_token_counts(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of every whole text."""
    return _mapped(df, text_col, name, T.LongType(), pa.int64(), lambda c, texts: [c.count(x) for x in texts], vocabulary, pattern)


def with_prefix_counts(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, name: str = "prefix_counts") -> DataFrame:
    """``df`` with an array: entry i is the token count of the text's first i characters."""
    kind = T.ArrayType(T.IntegerType(), False)
    return _mapped(df, text_col, name, kind, pa.list_(pa.field("element", pa.int32(), False)), lambda c, texts: [c.prefix_counts(x) for x in texts], vocabulary, pattern)


def count_at(counts, position):
    """Tokens of the first ``position`` characters, from a prefix_counts column."""
    return F.element_at(counts, F.least(F.lit(position), F.size(counts) - 1) + 1)


def longest_within(counts, budget):
    """Most leading characters whose token count is within ``budget``."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= F.lit(budget), i).otherwise(0)))


def truncated(text, counts, budget):
    """The longest prefix of the text within the token budget, cut between characters."""
    return F.substring(text, F.lit(1), longest_within(counts, budget))


def _mapped(df, text_col, name, kind, arrow_kind, compute, vocabulary, pattern) -> DataFrame:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has a column named {name}")
    path, split = _arguments(vocabulary, pattern)
    columns = [F.col(quoted(c)) for c in df.columns]
    at = len(columns)
    source = df.select(*columns, F.col(quoted(text_col)).cast("string").alias(name))
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def scan(batches):
        known = counter(path, split)
        for batch in batches:
            made = pa.array(compute(known, (x.as_py() for x in batch.column(at))), arrow_kind)
            fields = [*list(batch.schema)[:at], pa.field(name, arrow_kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made], schema=pa.schema(fields))

    return mapped(source, scan, schema)


def document_token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and within_limit (the leading characters whose tokens are
    within the limit, from the prefix tables) of every document."""
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    path, split = _arguments(vocabulary, None)

    def scan(batches):
        known = counter(path, split)
        for batch in batches:
            made = [known.measure(x.as_py(), limit) for x in batch.column(2)]
            counts, cuts = (pa.array([m[k] for m in made], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts, cuts], names=["doc_id", "n_bytes", "n_tokens", "within_limit"])

    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_bytes", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "within_limit")]])
    return slim.mapInArrow(scan, schema).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "within_limit")
