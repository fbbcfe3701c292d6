"""SimHash near-duplicates found by multi-index hashing.

Fingerprints (64 bits, majority vote over the XXH64 of 4-word shingles) link when they differ in at
most ``radius`` bits.  The fingerprint is cut into ``segments`` parts; two fingerprints within the
radius agree in some part up to ``radius // segments`` bits, so every fingerprint looks up the whole
Hamming ball of that radius around each of its parts in the table of that part, and each match is
verified on all 64 bits.  Nothing is missed and nothing else is linked.

Scale: equal fingerprints are collapsed first, so copies cost one row.  Three parts of 21-22 bits
mean 67 look-ups a fingerprint of 16 bytes each; the verification is part of the join's condition, so
only true links leave it.  Parts shared by more than ``block_rows`` fingerprints are compared in
blocks that give back spanning forests (see hotblocks), so a dense group never becomes all its pairs.
Beyond ``THREE_PARTS`` counted fingerprints two parts of 32 bits (1,058 look-ups) have fewer chance
matches; the links are the same.

Defined results: a null or wordless text has fingerprint zero and links like any other; rows with a
null doc_id take their component from their group (null if no row of the component has an id);
repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.hotblocks import block_pairs, cold_rows, forest, hot_buckets
from vecloom.llm.tables import free_name, quoted
from vecloom.plans.components import connected_components
from vecloom.plans.durable import materialize

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
RADIUS = 4
SHINGLE = 4
SEED = 42
THREE_PARTS = 1 << 30  # different fingerprints up to which three parts are the better cut


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; bits set in over half of the shingle hashes."""
    words = WORD.findall((text or "").encode("utf-8").translate(LOWER))
    if not words:
        return 0
    bits, total = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, total, 65536):  # very long texts in slices
        stop = min(start + 65536, total)
        grams = [b" ".join(words[i : i + shingle]) for i in range(start, stop)]
        hashes = np.fromiter(map(_hash, grams), np.uint64, stop - start)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((bits * 2 > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _hash(gram: bytes) -> int:
    return xxhash.xxh64_intdigest(gram, SEED)


def with_fingerprint(docs: DataFrame, keep: list, text_col: str = "text", name: str = "fp") -> DataFrame:
    """The columns ``keep`` (Columns with aliases) and the signed 64-bit fingerprint of each row."""
    source = docs.select(*keep, F.col(quoted(text_col)).cast("string").alias(name))
    schema = source.drop(name).withColumn(name, F.lit(0).cast("long")).schema

    def scan(batches):
        for batch in batches:
            at = batch.schema.get_field_index(name)
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(prints)], schema=pa.schema([*list(batch.schema)[:at], pa.field(name, pa.int64())]))

    return source.mapInArrow(scan, schema)


def _parts(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each part."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cell(part: int, value: Column) -> Column:
    return F.struct(F.lit(part).cast("byte").alias("part"), value.alias("value"))


def _ball(part: int, value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda mask: _cell(part, value.bitwiseXOR(mask)))


def _tables(prints: DataFrame, segments: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Index rows (part, value, fp), one a part, and probe rows, one for each value in the balls."""
    index, probe = [], []
    for part, (shift, bits) in enumerate(_parts(segments)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
        masks = [sum(1 << b for b in c) for r in range(radius // segments + 1) for c in combinations(range(bits), r)]
        index.append(_cell(part, value))
        probe.append(_ball(part, value, masks))
    rows = lambda cells: prints.select("fp", F.explode(cells).alias("c")).select("c.part", "c.value", "fp")
    return rows(F.array(*index)), rows(F.flatten(F.array(*probe)))


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, segments: int = 3, block_rows: int = 512) -> DataFrame:
    """(src, dst) edges whose components are those of "differs in at most ``radius`` bits".

    ``prints`` holds different non-null ``fp`` values.  Parts in use up to ``block_rows`` times give
    every link; larger ones give a spanning forest of theirs.
    """
    index, probe = _tables(prints, segments, radius)
    keys = ["part", "value"]
    hot = hot_buckets(index, keys, block_rows)
    any_hot = not hot.isEmpty()
    i = (cold_rows(index, hot, keys) if any_hot else index).alias("i")
    p = probe.alias("p")
    near = (
        (F.col("p.part") == F.col("i.part"))
        & (F.col("p.value") == F.col("i.value"))
        & (F.col("p.fp") < F.col("i.fp"))
        & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= radius)
    )
    links = p.join(i, near).select(F.col("p.fp").alias("src"), F.col("i.fp").alias("dst"))
    if not any_hot:
        return links

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fps, is_probe = rows["fp"].to_numpy(np.int64), rows["is_probe"].to_numpy(bool)
        a, b = fps[is_probe], fps[~is_probe]
        apart = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])
        node, low = forest((apart <= radius) & (a[:, None] != b[None, :]), a, b)
        return pd.DataFrame({"src": node, "dst": low})

    blocks = block_pairs(index, probe, hot, keys, F.col("fp"), block_rows)
    return links.unionByName(blocks.applyInPandas(compare, "src long, dst long"))


def group_by_fingerprint(prints: DataFrame, radius: int = RADIUS, segments: int | None = None, order: str = "doc_id") -> DataFrame:
    """(fp, component_id): for each different fingerprint, the smallest ``order`` its component holds."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(order).alias("first_id")), "fingerprints")
    segments = segments or (3 if nodes.count() <= THREE_PARTS else 2)
    linked = connected_components(fingerprint_links(nodes.select("fp"), radius, segments))  # a written table
    low = (
        linked.join(nodes, linked.node == nodes.fp)
        .groupBy("component")
        .agg(F.min("first_id").alias("component_id"))
        .join(linked, "component")
        .select(F.col("node").alias("fp"), "component_id")
    )
    return nodes.join(low, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id."""
    prints = materialize(with_fingerprint(docs, [F.col(quoted(id_col)).alias("doc_id")], text_col), "doc-fingerprints")
    groups = materialize(group_by_fingerprint(prints, radius, segments), "groups")  # its size known, the join can split hot fingerprints
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest hash of the row.

    Rows without an id stay only where no row of their component has one.
    """
    row_key = F.struct(
        F.col(quoted(id_col)).isNull().alias("no_id"),
        F.col(quoted(id_col)).alias("id"),
        # a null is marked where it stands: hashes leave it out
        F.xxhash64(*[F.col(quoted(c)).cast("string") for c in docs.columns], *[F.col(quoted(c)).isNull() for c in docs.columns]).alias("row"),
    )
    key = free_name(docs, "row_key")
    prints = materialize(with_fingerprint(docs, [row_key.alias("doc_key")], text_col), "row-fingerprints")
    groups = group_by_fingerprint(prints, radius, segments, order="doc_key")
    stay = groups.select(F.col("component_id").alias(key)).distinct()
    stay = stay.select(F.col(key)["id"].alias(f"{key}i"), F.col(key)["row"].alias(f"{key}r"))
    keyed = docs.select("*", row_key["id"].alias(f"{key}i"), row_key["row"].alias(f"{key}r"))

    def kept(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        same = rows[f"{key}i"].eqNullSafe(chosen[f"{key}i"]) & (rows[f"{key}r"] == chosen[f"{key}r"])
        return rows.join(chosen, same, how)

    # rows equal in every column share a key; only where there are any does a second pass single them out
    repeated = prints.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select(F.col("doc_key")["id"].alias(f"{key}i"), F.col("doc_key")["row"].alias(f"{key}r")), "repeated")
    columns = [F.col(quoted(c)) for c in docs.columns]
    if repeated.isEmpty():
        return kept(keyed, stay, "left_semi").select(*columns)
    single = kept(keyed, kept(stay, repeated, "left_anti"), "left_semi")
    several = kept(keyed, kept(stay, repeated, "left_semi"), "left_semi").dropDuplicates([f"{key}i", f"{key}r"])
    return single.select(*columns).unionByName(several.select(*columns))
