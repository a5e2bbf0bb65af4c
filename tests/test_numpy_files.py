import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import numpy_files as A


def fold(tmp_path, n=130):
    r = np.random.default_rng(0)
    d = {"X": r.standard_normal((n, 4, 3)).astype(np.float32), "y": r.integers(0, 7, n).astype(np.int8), "u": np.array([f"user-é{i % 5}" for i in range(n)]), "w": r.integers(0, 2**40, n), "aug": r.random(n) < 0.5, "other": np.zeros(7)}
    np.savez(tmp_path / "fold.npz", **d)
    np.savez_compressed(tmp_path / "small.npz", **d)
    return d


@pytest.mark.parametrize("name", ["fold.npz", "small.npz"])
def test_read(spark, tmp_path, name):
    d = fold(tmp_path)
    df = A.read_arrays(spark, str(tmp_path / name), ["X", "y", "u", "w", "aug"], rows=40)
    assert df.dtypes == [("X", "array<float>"), ("y", "tinyint"), ("u", "string"), ("w", "bigint"), ("aug", "boolean")] and df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert np.array_equal(np.array([r["X"] for r in rows], np.float32), d["X"].reshape(130, 12))
    assert [r["u"] for r in rows] == d["u"].tolist() and [r["w"] for r in rows] == d["w"].tolist() and [r["y"] for r in rows] == d["y"].tolist() and [r["aug"] for r in rows] == d["aug"].tolist()
    some = A.read_arrays(spark, "file://" + str(tmp_path / name), ["w"], 45, 52).collect()
    assert [r["w"] for r in some] == d["w"][45:52].tolist()
    with pytest.raises(Exception, match="numbers of rows"):
        A.read_arrays(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="no array z"):
        A.read_arrays(spark, str(tmp_path / name), ["z"]).collect()


def test_a_range_is_all_that_is_read(tmp_path, monkeypatch):
    d = fold(tmp_path)
    a = A.arrays_of(str(tmp_path / "fold.npz"))["X"]
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append((self.f.tell(), n))
            return self.f.read(n)

    class System:
        def open_input_file(self, path):
            return Counting(open(path, "rb"))

    monkeypatch.setattr(A, "opened", lambda path: (System(), path))
    assert np.array_equal(A.rows_of(a, 50, 53), d["X"][50:53])
    assert read == [(a.at + 50 * 48, 3 * 48)]


def test_round_trip(spark, tmp_path):
    df = spark.range(230, numPartitions=3).select("id", (F.col("id") % 7).cast("int").alias("y"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("v"), F.concat(F.lit("é"), "id").alias("s"))
    path = str(tmp_path / "out")
    A.write_arrays(df, path, rows=50)
    files = [f for f in os.listdir(path)]
    assert len(files) == 6 and all(f.startswith("part-") and f.endswith(".npz") for f in files)
    assert sum(len(np.load(f"{path}/{f}")["y"]) for f in files) == 230
    back = A.read_arrays(spark, path, rows=20)
    assert back.dtypes == df.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    A.write_arrays(df.limit(5), path)
    assert A.read_arrays(spark, path).count() == 5
    A.write_arrays(df.limit(5), path, overwrite=False)
    assert A.read_arrays(spark, path).count() == 10


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(20).select("id")
    A.write_arrays(good, path)
    before = sorted(os.listdir(path))
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") != 77, F.col("id")).alias("id"))
    with pytest.raises(Exception):
        A.write_arrays(broken, path)
    assert sorted(os.listdir(path)) == before and A.read_arrays(spark, path).count() == 20


def test_folder_of_arrays(spark, tmp_path):
    x = np.arange(24, dtype=np.float64).reshape(6, 4)
    np.save(tmp_path / "X_val.npy", x)
    np.save(tmp_path / "y_val.npy", np.arange(6, dtype=np.uint8))
    np.save(tmp_path / "norm_mean.npy", np.zeros(6, np.float32))
    rows = A.read_arrays(spark, str(tmp_path), ["X_val", "y_val"], rows=4).collect()
    assert [r["X_val"] for r in rows] == x.tolist() and [r["y_val"] for r in rows] == list(range(6))
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(ValueError):
        A.arrays_of(str(tmp_path))
