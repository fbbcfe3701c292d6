"""Packing documents into fixed windows of tokens: bounded-space online best fit.

Every partition packs the documents it reads as they come.  It keeps at most ``open_windows`` windows open;
a document goes into the fullest one it fits into whole, into a new one while there are fewer, and where
none fits the fullest is emitted: topped up with the head of the document if that takes at least
``least_piece`` tokens, as it is otherwise.  Documents longer than a window fill windows of their own and
only their tail is placed.  What is still open at the end of a partition is merged with the leftovers of
others by the same rule, and the one window a merge cannot fill is written as sequences of power-of-two
lengths, which need no padding.  So padding is less than ``least_piece`` tokens a window everywhere.

Scale: tokens are made, placed and written in one narrow pass; memory is ``open_windows`` windows and a
buffer, whatever the documents are.  Only leftovers are exchanged - at most ``open_windows`` windows a
partition, in groups of about ``group_windows`` whose number follows from their count.  The first pass is
written before leftovers are merged, so a recomputed task cannot pack the same document twice.

Defined results: a null text is empty and still gives its closing id; every token of a row lies in exactly
one piece, and pieces of a row lie in different sequences; a null id is an id, and repeated rows are packed
one by one; which documents share a window depends on the partitions they are read in; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.tables import quoted
from vecloom.llm.token_counts import _byte_alphabet, default_vocabulary
from vecloom.plans.durable import materialize

WINDOW = 1024
OPEN_WINDOWS = 32
LEAST_PIECE = 8
GROUP_WINDOWS = 64
CLOSING_ID = 0
BUFFERED_TOKENS = 1 << 20
MERGED = 1 << 30  # sequences of merges are numbered above those of any partition


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    The file's merges are run by ``tiktoken``, a third of the time for the same ids, wherever ids rise with
    the rank of their merge; the library itself takes other files, and texts that tiktoken gives up on.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = _byte_alphabet(), spec["model"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {token: bytes(alphabet[c] for c in token) for token in model["vocab"] if token not in special}
        pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
        made = [model["vocab"]["".join(pair)] for pair in pairs]
        self.fast = None
        if made == sorted(made) and len(raw) == 256 + len(made):
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks={raw[t]: k for t, k in model["vocab"].items() if t in raw}, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # its regular expressions panic on extreme runs of white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class Windows:
    """At most ``most`` open windows, best fit; ``emit(pieces)`` gets each window that closes.

    A piece is (id, start, tokens, tokens of its document); an item is a list of pieces placed as one.
    """

    def __init__(self, width: int, most: int, least: int, emit):
        self.width, self.most, self.least, self.emit = width, most, least, emit
        self.free: list[tuple[int, int]] = []  # (free tokens, window), fullest first
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, item: list, length: int) -> None:
        while length >= self.width:
            head, item = cut(item, self.width)
            length -= self.width
            self.emit(head)
        if not length:
            return
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            self._put(at, item, length)
            return
        if len(self.free) >= self.most:
            room, window = self.free[0]
            if room >= self.least and length - room >= self.least:
                head, item = cut(item, room)
                length -= room
                self._put(0, head, room)
                self.place(item, length)
                return
            del self.free[0]
            self.emit(self.held.pop(window))
        insort(self.free, (self.width - length, self.made))
        self.held[self.made] = item
        self.made += 1

    def _put(self, at: int, item: list, length: int) -> None:
        room, window = self.free.pop(at)
        self.held[window] = self.held[window] + item
        if room == length:
            self.emit(self.held.pop(window))
        else:
            insort(self.free, (room - length, window))

    def leftovers(self) -> list[list]:
        """What is open, fullest first; nothing is open afterwards."""
        out = [self.held[w] for _, w in self.free]
        self.free, self.held = [], {}
        return out

    def finish(self) -> None:
        """Fill the fullest from the emptiest until one is left, and emit that in powers of two."""
        while len(self.free) > 1:
            room, window = self.free[0]
            if room < self.least:
                del self.free[0]
                self.emit(self.held.pop(window))
                continue
            spare, last = self.free.pop()
            item = self.held.pop(last)
            take = min(room, self.width - spare)
            head, item = cut(item, take)
            self._put(0, head, take)
            if item:
                insort(self.free, (spare + take, last))
                self.held[last] = item
        for item in self.leftovers():
            while item:
                length = sum(len(piece[2]) for piece in item)
                whole = self.width - length < self.least
                head, item = cut(item, length if whole else 1 << (length.bit_length() - 1))
                self.emit(head)


def cut(item: list, length: int) -> tuple[list, list]:
    """The first ``length`` tokens of an item, and the rest."""
    head, rest, left = [], [], length
    for piece in item:
        ident, start, tokens, total = piece
        if left >= len(tokens):
            head.append(piece)
            left -= len(tokens)
        elif left:
            head.append((ident, start, tokens[:left], total))
            rest.append((ident, start + left, tokens[left:], total))
            left = 0
        else:
            rest.append(piece)
    return head, rest


class Rows:
    """Closed windows as Arrow batches."""

    NAMES = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    def __init__(self, number: int, kind: pa.DataType, id_name: str):
        self.next, self.kind, self.id_name = number << 32, kind, id_name
        self._clear()

    def _clear(self) -> None:
        self.idents, self.columns, self.open, self.tokens = [], [[] for _ in self.NAMES], [], 0

    def add(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for ident, start, tokens, total in pieces:
            self.idents.append(ident)
            for column, value in zip(self.columns, (start, len(tokens), tokens.tobytes(), total, self.next, offset)):
                column.append(value)
            self.open.append(is_open)
            offset += len(tokens)
        self.next += 1
        self.tokens += offset

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in self.NAMES]
        arrays = [pa.array(self.idents, self.kind), *[pa.array(c, k) for c, k in zip(self.columns, kinds)], pa.array(self.open, pa.bool_())]
        self._clear()
        return pa.RecordBatch.from_arrays(arrays, names=[self.id_name, *self.NAMES, "open"])


def pack(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    vocabulary: str | None = None,
    pattern: str | None = None,
    width: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_piece: int = LEAST_PIECE,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """One row a piece: the id column, start, length, ids (unsigned 32-bit little-endian numbers, as
    BINARY), doc_tokens, sequence_id and offset within the sequence."""
    if id_col.lower() in {*Rows.NAMES, "open"}:
        raise ValueError(f"the id column clashes with the column {id_col} of the result")
    if min(width, open_windows, least_piece, group_windows) < 1:
        raise ValueError("width, open_windows, least_piece and group_windows must be at least 1")
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or default_vocabulary(), pattern or public_tokenizers.PATTERN
    slim = df.select(F.col(quoted(id_col)).alias("ident"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(id_col, slim.schema["ident"].dataType), *[T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in Rows.NAMES], T.StructField("open", T.BooleanType())])

    def scan(batches):
        encode, rows = encoder(vocabulary, pattern), None
        for batch in batches:
            if rows is None:
                rows = Rows(TaskContext.get().partitionId(), batch.schema.field(0).type, id_col)
                windows = Windows(width, open_windows, least_piece, rows.add)
            for ident, text in zip(batch.column(0), batch.column(1)):
                tokens = np.append(encode(text.as_py()), np.array([CLOSING_ID], "<u4"))
                windows.place([(ident.as_py(), 0, tokens, len(tokens))], len(tokens))
                if rows.tokens >= BUFFERED_TOKENS:
                    yield rows.batch()
        if rows is not None:
            for pieces in windows.leftovers():
                rows.add(pieces, is_open=True)
            yield rows.batch()

    packed = materialize(slim.mapInArrow(scan, schema), "packed")
    closed = packed.where(~F.col("open")).drop("open")
    leftovers = packed.where("open")
    count = leftovers.where(F.col("offset") == 0).count()
    if not count:
        return closed
    groups = math.ceil(count / group_windows)

    def merge(key, table):
        rows = Rows(MERGED + key[0].as_py(), table.schema.field(id_col).type, id_col)
        windows = Windows(width, open_windows, least_piece, rows.add)
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        items: dict[int, list] = {}
        for ident, start, ids, total, number in zip(*[table.column(c).to_pylist() for c in (id_col, "start", "ids", "doc_tokens", "sequence_id")]):
            items.setdefault(number, []).append((ident, start, np.frombuffer(ids, "<u4"), total))
        sized = sorted(((sum(len(p[2]) for p in item), number) for number, item in items.items()), reverse=True)
        for length, number in sized:
            windows.place(items[number], length)
        windows.finish()
        return pa.Table.from_batches([rows.batch()])

    grouped = leftovers.withColumn("merge_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int")).groupBy("merge_group")
    return closed.unionByName(grouped.applyInArrow(merge, schema).drop("open"))


def sequences(pieces: DataFrame, width: int = WINDOW, padding: bytes = b"\x00\x00\x00\x00") -> DataFrame:
    """One row a sequence of ``pack``: its ids in a row, padded to ``width`` unless their number is a power
    of two, that number, and the lengths of its pieces (the segments an attention mask keeps apart).

    A sequence has at most ``width`` pieces, so its group is small whatever the documents are.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    rows = rows.select("sequence_id", joined.alias("ids"), n.alias("length"), F.transform("parts", lambda p: p["length"]).alias("segments"))
    short = width - F.col("length")
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    fill = F.when(power | (short <= 0), F.lit(0)).otherwise(short).cast("int")
    return rows.select("sequence_id", F.concat("ids", F.unhex(F.repeat(F.lit(padding.hex()), fill))).alias("ids"), "length", "segments")


def document_packing(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with a checksum of their ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
