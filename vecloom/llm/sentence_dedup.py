"""Substring deduplication over sliding runs of sentences.

A text is cut into whole sentences: after the marks . ! ? followed by space, after the full-width and
other marks of ``_BREAK`` with or without one, and at line ends.  Of the runs of at least ``RUN``
consecutive sentences with at least ``WORDS`` words the shortest from each sentence on and the shortest
up to each sentence are hashed (128 bits); together they cover every longer one.  Runs meet globally by
hash, and sentences covered by any occurrence but the first (smallest doc_id, then place) are removed.

``passage`` (off by default; the query gives 50) also removes every stretch of more than that many words
that an earlier document holds, wherever it lies: in long sentences, in texts without any marks, or over
the ends of sentences.  This is exact: rolling hashes of SEED words are thinned so that each stretch of
``passage + 1`` words keeps one.  A kept seed's surroundings hold all stretches around it: where they are
those of an earlier document (128 bits) they go as a whole, and only the first holders of each of several
surroundings of one seed have their stretches compared one by one (128 bits).  What is removed then may be
parts of sentences.

``longest`` (off by default) also cuts sentences of more words than that at places their own words
choose, never more than ``NEAR`` words apart, so that repeated stretches without any marks are found;
what is removed then may be parts of sentences.

Scale: hashing is one narrow Arrow map for runs and seeds; what is shuffled is one slim row a run or seed
(hashes, id, place).  Hashes are counted and first occurrences found with pre-aggregated group-bys that are
written before they are joined, so a passage in a third of all documents is one row a task; only what
repeats is handled in full.  Covered places are gathered by document, whose own size bounds them; texts move
to meet them, and once before where stretches are compared one by one.  Tables are dropped as soon as later ones are written.

Defined results: null and empty texts stay as they are; words are runs of non-space, and in scripts
written without spaces each character, compared without case; rows that share a doc_id are told apart by
a hash of their text, and rows equal in both are the same row repeated: each keeps what the first keeps;
null ids come last; texts shorter than a run, and, without ``passage``, texts without marks or line ends, are never changed; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.tables import free_name, mapped, quoted
from vecloom.plans.durable import materialized, materialize

RUN = 3
WORDS = 20
NEAR = 11
PASSAGE = 50  # words the query lets documents share
SEED = 26  # words of a hash that finds shared passages, at most PASSAGE
LAID = 1 << 20  # characters of texts laid out in one go, or one text
CHARS = 1 << 16  # characters hashed in one go, or one word
WORD = re.compile(r"\S+")
_BREAK = re.compile("[.!?]+[\"'\u2019\u201d)\\]]*\\s+|[\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u1362\u104b\u17d4]+[\u201d\u2019\u300d\u300f\uff09]*\\s*|\n\\s*")
#: Scripts without spaces between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_TOKEN = re.compile(f"{_UNSPACED.pattern}|(?:(?!{_UNSPACED.pattern})\\S)+")
_FULL_STOPS = re.compile("[\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u1362\u104b\u17d4]")
_SPACE, _MARK, _CLOSER = (np.array([test(chr(c)) for c in range(0x3002)]) for test in (str.isspace, ".!?".__contains__, "\"'\u2019\u201d)]".__contains__))
_BASES = np.array([0x9E3779B97F4A7C1B, 0xD1342543DE82EF93], np.uint64)  # 3 modulo 8

_SPAN = [*(T.StructField(n, T.LongType()) for n in ("run", "rest")), *(T.StructField(n, T.IntegerType()) for n in ("start", "end"))]


def _digest(words: str) -> bytes:
    return xxhash.xxh3_128_digest(words.encode("utf-8", "replace"), 3)


def sentences(text: str, longest: int | None = None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, hash) of each sentence; the spans cover the text without gaps."""
    found: list[tuple[int, int, int, bytes]] = []
    unspaced = _UNSPACED.search(text) is not None
    for start, end in _spans(text):
        start = start if found else 0  # leading blanks belong to the first sentence
        part = text[start:end].lower()
        words = part.split()
        if not words:
            if found:  # blank: belongs to the sentence before
                a, _, n, h = found[-1]
                found[-1] = (a, end, n, h)
            continue
        size = len(words) + (len(_UNSPACED.findall(part)) if unspaced else 0)
        if longest is None or len(words) <= longest:
            found.append((start, end, size, _digest(" ".join(words))))
            continue
        starts = [m.start() for m in WORD.finditer(text, start, end)]
        first, at, last = 0, start, len(words) - 1
        for k in cuts([xxhash.xxh32_intdigest(w.encode("utf-8", "replace"), 5) for w in words]):
            if k != last:
                found.append((at, starts[k + 1], k + 1 - first, _digest(" ".join(words[first : k + 1]))))
                first, at = k + 1, starts[k + 1]
        found.append((at, end, last + 1 - first, _digest(" ".join(words[first:]))))
    return found


def cuts(hashes: list[int]) -> list[int]:
    """The places of the smallest (of equal ones the last) of every NEAR numbers in a row."""
    found: list[int] = []
    best = -1
    for i in range(NEAR - 1, len(hashes)):
        if best <= i - NEAR:
            window = hashes[i - NEAR + 1 : i + 1]
            best = i - window[::-1].index(min(window))
        elif hashes[i] <= hashes[best]:
            best = i
        else:
            continue
        found.append(best)
    return found


def _spans(text: str):
    start = 0
    for m in _BREAK.finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def run_pairs(sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the shortest runs of RUN sentences and WORDS words from each sentence on and up to
    each sentence, each once; ``low`` and ``high`` bound the sentences of each one's text."""
    counts, k = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(sizes))
    on = np.maximum(np.searchsorted(counts, counts[:-1] + WORDS), k + RUN)
    back = np.minimum(np.searchsorted(counts, counts[1:] - WORDS, "right") - 1, k + 1 - RUN)
    ahead, behind = on <= high, back >= low
    behind[behind] = on[back[behind]] != k[behind] + 1
    return np.concatenate([k[ahead], back[behind]]), np.concatenate([on[ahead], k[behind] + 1])


def runs(found: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes as two numbers each, places, lengths) of the runs of one text."""
    n = len(found)
    packed = b"".join(f[3] for f in found)
    first, stop = run_pairs(np.array([f[2] for f in found], np.int64), np.zeros(n, np.int64), np.full(n, n))
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(packed[16 * i : 16 * j], 7) for i, j in zip(first, stop)), dtype=np.int64).reshape(-1, 2)
    return hashes, first.astype(np.int32), (stop - first).astype(np.int32)


class _WordHashes:
    """Hashes of the words of a text from its characters, with the powers they need."""

    def __init__(self):
        self.powers: list[np.ndarray] = []

    def spans(self, values: np.ndarray, first: np.ndarray, last: np.ndarray, extra: np.ndarray | int = 0, parts: int = 2) -> np.ndarray:
        """(parts, spans): a rolling hash of the numbers [first, last) of each part, and of ``extra``."""
        n = values.shape[1]
        if not self.powers or len(self.powers[0]) <= n:
            self.powers = [_powers(base, max(n, CHARS) + 1) for base in (*_BASES.tolist(), *(pow(b, -1, 1 << 64) for b in _BASES.tolist()))]
        found = np.zeros((parts, len(first)), np.uint64)
        extra = np.asarray(extra).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        for k in range(parts):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[k] * self.powers[k][:n], dtype=np.uint64)])
            found[k] = _mixed((sums[last] - sums[first]) * self.powers[2 + k][first] + extra)
        return found

    def read(self, text: str) -> tuple[np.ndarray, ...]:
        """(2, words): hashes; (words): whether each closes a sentence, where it begins; words before each line end."""
        codes = _codes(text)
        small = np.minimum(codes, len(_SPACE) - 1) if codes.itemsize > 1 else codes
        blank = np.concatenate([[True], _SPACE[small], [True]])
        first = np.flatnonzero(blank[:-2] & ~blank[1:-1])
        last = np.flatnonzero(blank[2:] & ~blank[1:-1]) + 1
        hashes = np.zeros((2, len(first)), np.uint64)
        bounds = np.unique(np.append(np.searchsorted(first, np.arange(0, len(codes), CHARS)), len(first)))
        for a, b in zip(bounds[:-1], bounds[1:]):
            values = _mixed(codes[first[a] : last[b - 1]].astype(np.uint64) + _BASES[0])
            hashes[:, a:b] = self.spans(np.broadcast_to(values, (2, len(values))), first[a:b] - first[a], last[a:b] - first[a])
        ends = last - 1
        if _CLOSER[small[ends]].any():
            ends = np.maximum.accumulate(np.where(_CLOSER[small], 0, np.arange(len(codes))))[ends]
        closed = _MARK[small[ends]] & (ends >= first)
        return hashes, closed, first, np.searchsorted(first, np.flatnonzero(codes == 10))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(text: str, known: _WordHashes) -> np.ndarray:
    """(2, words): the hash of each word, without case; in scripts without spaces of each character."""
    return known.read(" ".join(_words(text)))[0]


def _words(text: str) -> list[str]:
    return text.lower().split() if _UNSPACED.search(text) is None else _TOKEN.findall(text.lower())


def _plain(text: str) -> bool:
    """Whether words lie between blanks and sentences end only with them."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return _UNSPACED.search(text) is None and _FULL_STOPS.search(text) is None


class Laid:
    """The words of some texts one after another: hashes, where each begins and ends in its text (blanks belong
    to the word before, leading ones to the first), the texts' numbers and bounds.  Texts whose sentences may
    end within words are there twice, once for their sentences."""

    def __init__(self, texts: list[str], known: _WordHashes, longest: int | None = None, runs: bool = True):
        self.known = known
        lowered = [x.lower() for x in texts]
        alike = [len(low) == len(x) and _plain(x) and (longest is None or not runs) for x, low in zip(texts, lowered)]
        owner = [k for k, same in enumerate(alike) if same]
        sizes = np.array([len(texts[k]) + 1 for k in owner], np.int64)
        words: list[str] = []
        bounds: list[np.ndarray] = []
        kinds, highs, stops, weights = [], [], [], []  # of the other texts
        for k in (k for k, same in enumerate(alike) if not same):
            text, found = texts[k], WORD if _UNSPACED.search(texts[k]) is None else _TOKEN
            words += _words(text)
            starts = np.array([0, *[m.start() for m in found.finditer(text)][1:], len(text)], np.int64)
            bounds.append(np.stack([starts[:-1], starts[1:]]) if text.strip() else np.zeros((2, 0), np.int64))
            owner.append(k)
            kinds.append(2)
            highs.append(len(words))
            for a, b, size, _ in sentences(text, longest) if runs else ():
                part = text[a:b].lower().split()
                weights.append((len(words), size - len(part) + 1))
                words += part
                stops.append(len(words))
                bounds.append(np.repeat([[a], [b]], len(part), axis=1))
            if runs:
                owner.append(k)
                kinds.append(1)
                highs.append(len(words))
        joined = "\n".join([lowered[k] for k in owner[: len(sizes)]])
        self.words, self.last, first, lines = known.read(f"{joined}\n{' '.join(words)}")  # ``last`` words of sentences
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        edges = np.searchsorted(first, offsets)  # of the texts alike
        self.owner, self.kind = np.array(owner, np.int64), np.array([3] * len(sizes) + kinds, np.int64)
        self.high = np.concatenate([edges[1:], np.array(highs, np.int64) + edges[-1]])
        self.low = np.concatenate([[0], self.high]).astype(np.int64)[:-1]
        self.piece = np.repeat(np.arange(len(owner)), self.high - self.low)  # of each word
        self.begin = first[: edges[-1]] - offsets[self.piece[: edges[-1]]]
        filled = edges[1:] > edges[:-1]
        self.begin[edges[:-1][filled]] = 0
        self.end = np.append(self.begin[1:], 0)[: len(self.begin)]
        self.end[edges[1:][filled] - 1] = sizes[filled] - 1
        both = np.concatenate([np.zeros((2, 0), np.int64), *bounds], axis=1)
        self.begin, self.end = np.append(self.begin, both[0]), np.append(self.end, both[1])
        stops = np.concatenate([lines, np.array(stops, np.int64) + edges[-1], self.high])
        self.last[stops[stops > 0] - 1] = True
        self.weights = np.ones(len(self.piece), np.int64)
        for at, weight in weights:
            self.weights[edges[-1] + at] = weight

    def runs(self) -> tuple[np.ndarray, ...]:
        """(texts, hashes, begins, ends) of the runs of sentences."""
        stops = np.flatnonzero(self.last) + 1
        firsts = np.concatenate([[0], stops]).astype(np.int64)[: len(stops)]
        sizes = np.add.reduceat(self.weights, firsts) if len(firsts) else np.zeros(0, np.int64)
        low, high = np.searchsorted(firsts, self.low), np.searchsorted(firsts, self.high)
        of = self.piece[firsts]
        i, j = run_pairs(sizes, low[of], high[of])
        wanted = self.kind[of[i]] != 2
        i, j = i[wanted], j[wanted]
        marked = self.words.copy()
        marked[:, firsts] += _BASES[:, None]  # where sentences start is part of a run
        first, last = firsts[i], stops[j - 1]
        return self.owner[of[i]], self.known.spans(marked, first, last), self.begin[first], self.end[last - 1]

    def seeds(self, passage: int) -> tuple[np.ndarray, ...]:
        """(texts, hashes of seeds, hashes of all stretches around each, begins and ends of those)."""
        hashes, places = seeds(self.words, passage, self.high[self.piece], self.known)
        wanted = self.kind[self.piece[places]] != 1
        hashes, places = hashes[wanted], places[wanted]
        of, size = self.piece[places], min(SEED, passage)
        first, last = np.maximum(places + size - passage - 1, self.low[of]), np.minimum(places + passage + 1, self.high[of])
        around = self.known.spans(self.words, first, last, (places - first) * 1024 + last - places)
        return self.owner[of], hashes, around, self.begin[first], self.end[last - 1]

    def stretches(self, passage: int, around: list[list[dict]]) -> tuple[np.ndarray, ...]:
        """(texts, hashes, begins, ends) of the stretches within the places of each text."""
        edges = np.zeros(len(self.piece) + 1, np.int64)
        for low, high, k in zip(self.low, self.high, self.owner):
            both = np.array([(p["start"], p["end"]) for p in around[k]], np.int64).reshape(-1, 2)
            first, last = np.searchsorted(self.begin[low:high], both[:, 0]) + low, np.searchsorted(self.end[low:high], both[:, 1]) + low
            np.add.at(edges, first, 1)
            np.add.at(edges, last + 1 - passage, -1)
        first = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        last = first + passage + 1
        return self.owner[self.piece[first]], self.known.spans(self.words, first, last), self.begin[first], self.end[last - 1]


def laid_out(texts: pa.Array, known: _WordHashes, longest: int | None = None, runs: bool = True):
    """(number of the first, number after the last, texts laid out): some texts at a time."""
    held, start, size = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= LAID or k + 1 == len(texts):
            yield start, k + 1, Laid(held, known, longest, runs)
            held, start, size = [], k + 1, 0


def seeds(words: np.ndarray, passage: int, high: np.ndarray | None = None, known: _WordHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of stretches of SEED words, at least one within every ``passage + 1`` words of a text:
    the first of those whose upper 32 bits are least.  ``high`` is where the text of each word ends."""
    n, size = words.shape[1], min(SEED, passage)
    if n <= passage:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n - size + 1)
    hashes = (known or _WordHashes()).spans(words, at, at + size, parts=1)[0]
    least, held, width = hashes >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), 1, passage + 2 - size
    while held < width:
        step = min(held, width - held)
        least = np.minimum(least[: len(least) - step], least[step:])
        held += step
    if high is not None:
        least = least[np.arange(n - passage) + passage < high[: n - passage]]
    places = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
    return hashes[places], places


def _row_key(id_col: str, text_col: str):
    return F.struct(
        F.col(quoted(id_col)).isNull().alias("no_id"),
        F.col(quoted(id_col)).alias("id"),
        F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("version"),
    )


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_row_key(id_col, text_col).alias("key"), F.col(quoted(text_col)).cast("string").alias("text")).where("text is not null")


def _listed(texts: int, owner: np.ndarray, *columns: tuple[str, np.ndarray]) -> pa.Array:
    """Columns of numbers as one list of structs a text."""
    order = np.argsort(owner, kind="stable")
    fields = [pa.array(np.ascontiguousarray(c[order]).view(np.int64) if c.dtype == np.uint64 else c[order].astype(np.int32)) for _, c in columns]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=[n for n, _ in columns]))


def hash_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int | None = None, passage: int | None = None) -> DataFrame:
    """(key, runs, seeds): one row a text with its runs, and its seeds with what lies around them; ``run`` and
    ``rest`` are the hash of what lies from ``start`` to ``end``."""
    slim = _slim(docs, id_col, text_col)
    listed = [T.StructField(n, T.ArrayType(T.StructType([*first, *_SPAN]))) for n, first in (("runs", []), ("seeds", [T.StructField("seed", T.LongType())]))]
    schema = T.StructType([slim.schema["key"], *listed])

    def scan(batches):
        known = _WordHashes()
        for batch in batches:
            for start, stop, laid in laid_out(batch.column(1), known, longest):
                owner, both, begin, end = laid.runs()
                found = _listed(stop - start, owner, ("run", both[0]), ("rest", both[1]), ("start", begin), ("end", end))
                owner, seed, both, begin, end = laid.seeds(passage if passage is not None else len(laid.piece))
                around = _listed(stop - start, owner, ("seed", seed), ("run", both[0]), ("rest", both[1]), ("start", begin), ("end", end))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), found, around], names=["key", "runs", "seeds"])

    return slim.mapInArrow(scan, schema)


def repeated_runs(table: DataFrame) -> DataFrame:
    """(key, start, end): the runs of each text that occur before."""
    runs = table.select("key", F.explode("runs").alias("r")).select("key", "r.run", "r.rest", "r.start", "r.end")
    # most runs occur once: only hashes move to find the others, then only repeated runs in full
    often = materialized(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("run"), "repeated-hashes")
    repeated = materialized(runs.join(often.df, "run", "left_semi"), "repeated-runs")
    often.drop()
    firsts = materialized(repeated.df.groupBy("run", "rest").agg(F.min(F.struct("key", "start")).alias("first")), "first-runs")
    later = repeated.df.join(firsts.df, ["run", "rest"]).where(F.struct("key", "start") != F.col("first"))
    covered = materialize(later.select("key", "start", "end"), "covered-runs")
    repeated.drop()
    firsts.drop()
    return covered


def repeated_stretches(table: DataFrame, docs: DataFrame, passage: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, start, end): stretches of more than ``passage`` words of each text that an earlier document holds."""
    slim = _slim(docs, id_col, text_col)
    schema = T.StructType([slim.schema["key"], *_SPAN])

    def scan(batches):
        known = _WordHashes()
        for batch in batches:
            places = batch.column(2)
            for start, stop, laid in laid_out(batch.column(1), known, runs=False):
                owner, both, begin, end = laid.stretches(passage, places.slice(start, stop - start).to_pylist())
                columns = [*(pa.array(x.view(np.int64)) for x in both), *(pa.array(x.astype(np.int32)) for x in (begin, end))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start).take(pa.array(owner)), *columns], names=schema.names)

    seeds = table.select("key", F.explode("seeds").alias("s")).select("key", "s.seed", "s.run", "s.rest", "s.start", "s.end")
    spread = seeds.groupBy("seed").agg(F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high"))
    several = materialized(spread.where("low != high").select("seed"), "shared-hashes")
    shared = materialized(seeds.join(several.df, "seed", "left_semi"), "shared-seeds")
    several.drop()
    around = materialized(shared.df.groupBy("seed", "run", "rest").agg(F.min("key").alias("first")), "first-surroundings")
    varied = materialized(around.df.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "varied-seeds")
    met = materialized(shared.df.join(around.df, ["seed", "run", "rest"]).select("key", "seed", "start", "end", (F.col("key") == F.col("first")).alias("own")), "met-seeds")
    shared.drop()
    around.drop()
    places = met.df.where("own").join(varied.df, "seed", "left_semi").groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    stretches = materialized(slim.join(places, "key").select("key", "text", "places").mapInArrow(scan, schema), "stretches")
    varied.drop()
    firsts = materialized(stretches.df.groupBy("run", "rest").agg(F.min("key").alias("first")), "first-stretches")
    later = stretches.df.join(firsts.df, ["run", "rest"]).where("key != first")
    covered = materialize(met.df.where("not own").select("key", "start", "end").unionByName(later.select("key", "start", "end")), "covered-stretches")
    for table in (met, stretches, firsts):
        table.drop()
    return covered


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_name: str = "removed", kept_name: str = "kept_text", longest: int | None = None, passage: int | None = None) -> DataFrame:
    """``docs`` with the removed character spans [start, end) and the text without them."""
    if {spans_name.lower(), kept_name.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has a column named {spans_name} or {kept_name}")
    table = materialized(hash_table(docs, id_col, text_col, longest, passage), "hashes")
    covered = repeated_runs(table.df)
    if passage is not None:
        covered = covered.unionByName(repeated_stretches(table.df, docs, passage, id_col, text_col))
    table.drop()
    covered = covered.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    key, places = free_name(docs, "key"), free_name(docs, "places")
    slim = covered.select(F.col("key").alias(key), F.col("places").alias(places))
    slim = slim.select(F.col(key)["id"].alias(f"{key}i"), F.col(key)["version"].alias(f"{key}v"), places)
    keyed = docs.withColumns({f"{key}a": F.col(quoted(id_col)), f"{key}b": F.xxhash64(F.col(quoted(text_col)).cast("string"))})
    met = keyed.join(slim, keyed[f"{key}a"].eqNullSafe(slim[f"{key}i"]) & (keyed[f"{key}b"] == slim[f"{key}v"]), "left")
    columns = [F.col(quoted(c)) for c in docs.columns]
    rows = met.select(*columns, F.col(quoted(text_col)).cast("string").alias(spans_name), F.col(places).alias(kept_name))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_name, T.ArrayType(span)), T.StructField(kept_name, T.StringType())])
    at, arrow = len(columns), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        for batch in batches:
            spans, kept = [], []
            bounds = batch.column(at + 1)
            edges, ends = (bounds.flatten().field(n).to_numpy() for n in (0, 1))
            low = np.concatenate([[0], np.cumsum(bounds.value_lengths().fill_null(0).to_numpy())])
            for text, a, b in zip(batch.column(at), low[:-1], low[1:]):
                gone, rest = cut(text.as_py(), edges[a:b], ends[a:b])
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(rest)
            fields = [*list(batch.schema)[:at], pa.field(spans_name, arrow), pa.field(kept_name, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(spans, arrow), pa.array(kept, pa.string())], schema=pa.schema(fields))

    return mapped(rows, scan, schema)


def cut(text: str | None, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int]], str | None]:
    """The covered character spans as gapless ones, and the text without them."""
    if text is None or not len(starts):
        return [], text
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    gone = list(zip(starts[fresh].tolist(), ends[np.append(fresh[1:], True)].tolist()))
    kept, at = [], 0
    for start, end in gone:
        kept.append(text[at:start])
        at = end
    return gone, "".join([*kept, text[at:]])


def document_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed spans and the text that is left of every document."""
    out = deduplicated(docs.select("doc_id", "text"), passage=PASSAGE)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", removed.alias("n_removed"), "removed", F.col("kept_text").alias("text"))
