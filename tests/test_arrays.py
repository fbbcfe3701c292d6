"""NumPy and safetensors files: read in ranges on the executors, written by partitions."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import KMeans
from vecloom.sources.arrays import described, read_arrays, write_arrays


def rows_of(df):
    return {r["id"]: list(r["features"]) for r in df.collect()}


def safetensors(path, **tensors):
    header, data = {"__metadata__": {"made": "here"}}, b""
    for name, (kind, x) in tensors.items():
        raw = x.tobytes()
        header[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + data)


@pytest.mark.parametrize("kind", ["f8", "f4", "f2", "i4", "u1", ">f8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_numpy_kinds_and_orders(spark, tmp_path, kind, order):
    x = np.asarray(np.random.default_rng(0).integers(0, 90, (57, 3)), dtype=kind, order=order)
    np.save(tmp_path / "x.npy", x)
    df = read_arrays(spark, str(tmp_path / "x.npy"), split_bytes=8 * 3 * 10)
    assert df.schema["features"].dataType.elementType.typeName() == ("float" if kind in ("f4", "f2") else "double")
    assert df.rdd.getNumPartitions() == 6
    assert rows_of(df) == {i: [float(v) for v in row] for i, row in enumerate(x)}


def test_a_large_file_in_ranges(spark, tmp_path):
    n, d = 1_000_000, 64
    x = np.lib.format.open_memmap(tmp_path / "x.npy", "w+", np.float32, (n, d))
    x[:, 0], x[:, 63] = np.arange(n) % 1000, 1
    x.flush()
    df = read_arrays(spark, str(tmp_path / "x.npy"))
    assert df.rdd.getNumPartitions() == 8
    found = df.agg(F.count("id").alias("n"), F.sum("id").alias("ids"), F.sum(F.element_at("features", 1)).alias("a"), F.sum(F.element_at("features", 64)).alias("b")).first()
    assert tuple(found) == (n, n * (n - 1) // 2, 999 * 500 * 1000, n)


def test_shards_of_a_folder_are_numbered_on(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(30, 2))
    np.save(tmp_path / "b.npy", x[10:])
    np.save(tmp_path / "a.npy", x[:10])
    np.save(tmp_path / "c.npy", np.zeros((0, 2)))
    want = {i: row.tolist() for i, row in enumerate(x)}
    assert rows_of(read_arrays(spark, str(tmp_path))) == want == rows_of(read_arrays(spark, f"file://{tmp_path}/*.npy"))
    np.save(tmp_path / "d.npy", np.zeros((3, 5)))
    with pytest.raises(Exception, match="columns"):
        read_arrays(spark, str(tmp_path))


def test_safetensors(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(40, 4)).astype(np.float32)
    half = (x.view(np.uint32) >> 16).astype(np.uint16)
    path = str(tmp_path / "m.safetensors")
    safetensors(path, bias=("F32", np.ones(4, np.float32)), plain=("F32", x), brain=("BF16", half))
    assert rows_of(read_arrays(spark, path, "plain", split_bytes=300)) == {i: [float(v) for v in row] for i, row in enumerate(x)}
    assert np.allclose(list(rows_of(read_arrays(spark, path, "brain")).values()), x, rtol=0.01)
    for wrong in (None, "bias", "absent"):
        with pytest.raises(Exception, match="tensors|matrix"):
            read_arrays(spark, path, wrong)


def test_round_trip_keeps_ids(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(500, 6))
    df = spark.createDataFrame([(int(7 * i - 3), row.tolist()) for i, row in enumerate(x)], "key long, v array<double>").repartition(5)
    path = str(tmp_path / "out")
    write_arrays(df, path, "v", "key")
    assert not [f for f in os.listdir(path) if f.startswith("_")] and len(os.listdir(path)) == 10
    back = read_arrays(spark, path, split_bytes=2000)
    assert rows_of(back) == {7 * i - 3: row.tolist() for i, row in enumerate(x)}
    one = sorted(f for f in os.listdir(path) if not f.endswith(".ids.npy"))[0]
    assert np.load(os.path.join(path, one)).shape[1] == 6  # files that NumPy itself reads
    assert KMeans(3, n_init=1, max_iter=3).fit(back).cluster_centers_.shape == (3, 6)
    with pytest.raises(Exception, match="not empty"):
        write_arrays(df, path, "v", "key")


def test_edges(spark, tmp_path):
    np.save(tmp_path / "empty.npy", np.zeros((0, 4)))
    assert read_arrays(spark, str(tmp_path / "empty.npy")).count() == 0
    np.save(tmp_path / "flat.npy", np.zeros(4))
    with pytest.raises(ValueError, match="matrix"):
        described(str(tmp_path / "flat.npy"))
    for path in (str(tmp_path / "absent.npy"), "hdfs://there/x.npy"):
        with pytest.raises(Exception, match="no array files|mounted"):
            read_arrays(spark, path)
    kind = "id long, features array<double>"
    write_arrays(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert read_arrays(spark, str(tmp_path / "none")).count() == 0
    for bad in ([(1, None)], [(None, [1.0])], [(1, [None])], [(1, [1.0]), (2, [1.0, 2.0])]):
        target = str(tmp_path / f"bad{uuid_of(bad)}")
        with pytest.raises(Exception, match="nulls|dimensions"):
            write_arrays(spark.createDataFrame(bad, kind).coalesce(1), target)
        assert os.listdir(target) == []


def uuid_of(value):
    return abs(hash(str(value)))
