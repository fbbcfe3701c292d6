"""NumPy and safetensors files as a Spark data source: split by rows, memory-mapped where the tasks run.

``read_arrays(spark, path)`` gives (id, features) of a file, of a glob or of a folder of shards.  The driver
reads headers only; a task maps its own range of rows and hands them to Spark in Arrow batches, so neither
the driver nor a task ever holds a whole file.  Paths are folders that driver and executors share (mounted
storage; ``file:`` is understood, other schemes are refused, as such stores cannot be mapped).

``write_arrays(df, path)`` writes one pair of files a partition, ``NAME.npy`` with the vectors and
``NAME.ids.npy`` with their ids, in one pass; files get their final names when the whole job has succeeded,
so lost or repeated tasks leave nothing behind.

Where shards have such id files the ids are theirs; else rows are numbered in the order of the file names.
Half, bfloat16 and single precision become float, all else double.  Files must have two dimensions and
equally many columns.  An empty file gives no rows; a folder without files is an error.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "vecloom_arrays"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
HEADER = 128  # bytes of a NumPy header with room for any number of rows
# fixed values of the safetensors format
SAFE_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "bfloat16", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "<u1"}


def local_path(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped from mounted folders; {at.scheme}: is none")
    return unquote(at.path) if at.scheme else path


@dataclass
class Matrix:
    """Where the numbers of a file are."""

    path: str
    kind: str
    rows: int
    dims: int
    offset: int
    fortran: bool = False

    @property
    def single(self) -> bool:
        return self.kind == "bfloat16" or (np.dtype(self.kind).kind == "f" and np.dtype(self.kind).itemsize <= 4)

    def part(self, start: int, stop: int) -> np.ndarray:
        """Rows start to stop, as float32 or float64; only their pages are read."""
        stored = np.dtype("<u2" if self.kind == "bfloat16" else self.kind)
        held = np.memmap(self.path, stored, "r", self.offset, (self.rows, self.dims), "F" if self.fortran else "C")[start:stop]
        if self.kind == "bfloat16":
            return (held.astype(np.uint32) << 16).view(np.float32)
        return np.ascontiguousarray(held, dtype=np.float32 if self.single else np.float64)


def _numpy_header(path: str) -> tuple[tuple, bool, np.dtype, int]:
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        return shape, fortran, kind, f.tell()


def described(path: str, tensor: str | None = None) -> Matrix:
    """The matrix of a .npy file, or a tensor of a .safetensors file (its only one of two dimensions unless named)."""
    if path.endswith(".safetensors"):
        with open(path, "rb") as f:
            size = struct.unpack("<Q", f.read(8))[0]
            if size > os.path.getsize(path):
                raise ValueError(f"{path} is no safetensors file")
            header = json.loads(f.read(size))
        known = {k: v for k, v in header.items() if k != "__metadata__"}
        wanted = [tensor] if tensor is not None else [k for k, v in known.items() if len(v["shape"]) == 2]
        if len(wanted) != 1 or wanted[0] not in known:
            raise ValueError(f"{path} holds the tensors {sorted(known)}: name one of two dimensions")
        own = known[wanted[0]]
        if own["dtype"] not in SAFE_TYPES or len(own["shape"]) != 2:
            raise ValueError(f"{path}: {wanted[0]} is {own['dtype']} of shape {own['shape']}, not a matrix of numbers")
        return Matrix(path, SAFE_TYPES[own["dtype"]], *own["shape"], 8 + size + own["data_offsets"][0])
    shape, fortran, kind, offset = _numpy_header(path)
    if len(shape) != 2 or kind.kind not in "fiu":
        raise ValueError(f"{path} is {kind} of shape {shape}, not a matrix of numbers")
    return Matrix(path, kind.str, *shape, offset, fortran)


def _id_file(path: str) -> str:
    return path[: -len(".npy")] + ".ids.npy"


def files_of(path: str) -> list[str]:
    """The array files of a file name, glob or folder, in the order of their names."""
    path = local_path(path)
    if os.path.isdir(path):
        found = [f for end in ("npy", "safetensors") for f in glob.glob(os.path.join(glob.escape(path), f"*.{end}"))]
    else:
        found = [path] if os.path.isfile(path) else glob.glob(path)
    kept = [f for f in sorted(found) if not f.endswith(".ids.npy") and not os.path.basename(f).startswith(("_", "."))]
    if not kept:
        raise ValueError(f"no array files at {path}")
    return kept


@dataclass
class Range(InputPartition):
    matrix: Matrix
    start: int
    stop: int
    first: int  # the id of row ``start`` where the file has no ids of its own
    ids: str | None


class ArrayReader(DataSourceReader):
    def __init__(self, matrices: list[Matrix], single: bool, split_bytes: int):
        self.matrices, self.single, self.split_bytes = matrices, single, split_bytes

    def partitions(self):
        out, first = [], 0
        for m in self.matrices:
            ids = _id_file(m.path) if m.path.endswith(".npy") and os.path.exists(_id_file(m.path)) else None
            if ids is not None and _numpy_header(ids)[0] != (m.rows,):
                raise ValueError(f"{ids} does not have one id for each of {m.rows} rows")
            step = max(1, self.split_bytes // (8 * max(1, m.dims)))
            out += [Range(m, s, min(s + step, m.rows), first + s, ids) for s in range(0, m.rows, step)]
            first += m.rows
        return out or [Range(self.matrices[0], 0, 0, 0, None)]

    def read(self, part: Range):
        m, step = part.matrix, max(1, BATCH_BYTES // (8 * max(1, part.matrix.dims)))
        kind = np.float32 if self.single else np.float64
        ids = None if part.ids is None or part.start == part.stop else np.load(part.ids, mmap_mode="r")
        for s in range(part.start, part.stop, step):
            e = min(s + step, part.stop)
            x = m.part(s, e).astype(kind, copy=False)
            own = np.arange(part.first + s - part.start, part.first + e - part.start) if ids is None else np.asarray(ids[s:e], np.int64)
            ends = pa.array(np.arange(0, x.size + 1, max(1, m.dims), dtype=np.int32)[: len(x) + 1])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["id", "features"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Streams a partition into two files whose headers are filled in at the end."""

    def __init__(self, path: str, run: str, single: bool):
        self.path, self.run, self.kind = path, run, np.dtype("<f4" if single else "<f8")

    def write(self, iterator):
        # tasks may run twice, so every attempt has names of its own; the driver renames those that count
        name = os.path.join(self.path, f"_{self.run}-{uuid.uuid4().hex}.npy")
        rows, dims = 0, None
        try:
            with open(name, "wb") as vectors, open(_id_file(name), "wb") as ids:
                vectors.write(b"\0" * HEADER)
                ids.write(b"\0" * HEADER)
                for batch in iterator:
                    if not batch.num_rows:
                        continue
                    own, column = batch.column(0), batch.column(1)
                    if own.null_count or column.null_count or column.flatten().null_count:
                        raise ValueError("array files hold no nulls: ids and vectors must be known")
                    lengths = np.unique(np.diff(column.offsets.to_numpy()))
                    if len(lengths) != 1 or dims not in (None, int(lengths[0])):
                        raise ValueError("all vectors of an array file must have the same number of dimensions")
                    dims = int(lengths[0])
                    vectors.write(column.flatten().to_numpy(zero_copy_only=False).astype(self.kind).tobytes())
                    ids.write(own.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    rows += batch.num_rows
                for f, kind, shape in ((vectors, self.kind.str, (rows, dims or 0)), (ids, "<i8", (rows,))):
                    f.seek(0)
                    f.write(_header(kind, shape))
        except BaseException:
            _removed([name])
            raise
        if not rows:
            _removed([name])
        return Written([name] if rows else [])

    def commit(self, messages) -> None:
        names = [n for m in messages if m is not None for n in m.names]
        for i, name in enumerate(names):
            final = os.path.join(self.path, f"part-{i:06d}-{self.run}.npy")
            # ids first: a matrix is never visible without them
            os.replace(_id_file(name), _id_file(final))
            os.replace(name, final)
        if not names:
            empty = os.path.join(self.path, f"part-000000-{self.run}.npy")
            np.save(empty, np.zeros((0, 0), self.kind))

    def abort(self, messages) -> None:
        _removed(glob.glob(os.path.join(glob.escape(self.path), f"_{self.run}-*.npy")))


def _removed(names: list[str]) -> None:
    for name in names:
        for f in (name, _id_file(name)):
            if os.path.exists(f):
                os.remove(f)


def _header(kind: str, shape: tuple) -> bytes:
    text = repr({"descr": kind, "fortran_order": False, "shape": shape})
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", HEADER - 10) + text.ljust(HEADER - 11).encode() + b"\n"


class ArraySource(DataSource):
    """Options: ``path``, ``tensor`` (safetensors), ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _matrices(self) -> tuple[list[Matrix], bool]:
        found = [described(f, self.options.get("tensor")) for f in files_of(self.options["path"])]
        full = [m for m in found if m.rows] or found
        if len({m.dims for m in full}) > 1:
            raise ValueError(f"the files have {sorted({m.dims for m in full})} columns, they must have equally many")
        return found, all(m.single for m in full)

    def schema(self) -> str:
        return f"id long, features array<{'float' if self._matrices()[1] else 'double'}>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(*self._matrices(), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite) -> ArrayWriter:
        path = local_path(self.options["path"])
        os.makedirs(path, exist_ok=True)
        if os.listdir(path):
            raise ValueError(f"{path} is not empty")
        return ArrayWriter(path, uuid.uuid4().hex[:12], schema["features"].dataType.elementType.typeName() == "float")


def read_arrays(spark: SparkSession, path: str, tensor: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, features) of .npy or .safetensors files."""
    spark.dataSource.register(ArraySource)
    reader = spark.read.format(NAME).option("split_bytes", split_bytes)
    return (reader if tensor is None else reader.option("tensor", tensor)).load(path)


def write_arrays(df: DataFrame, path: str, features: str = "features", ident: str = "id") -> None:
    """The vectors and ids (integers) of ``df`` as files in ``path``, which must be new or empty."""
    df.sparkSession.dataSource.register(ArraySource)
    kind = "float" if df.schema[features].dataType.elementType.typeName() == "float" else "double"
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(features).cast(f"array<{kind}>").alias("features"))
    rows.write.format(NAME).mode("append").save(path)
