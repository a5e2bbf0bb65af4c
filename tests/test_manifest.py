"""Incremental rescaling: what is done is told by the version of the input."""

import os
import random

import pytest

from cadenza.operators import etl

SCHEMA = "user_id string, window long, t double, x double, y double, z double"
G = 9.80665


def rows_of(user, size, seed):
    r = random.Random(f"{user}{seed}")
    return [(user, w, float(i), size * (0.9 + 0.2 * r.random()), 0.0, 0.0) for w in range(4) for i in range(10)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_runs(spark, tmp_path):
    out, known = str(tmp_path / "out"), str(tmp_path / "manifest")
    data = {"a": rows_of("a", G, 1), "b": rows_of("b", 1.0, 1), "c": rows_of("c", 30.0, 1)}
    frame = lambda: spark.createDataFrame([x for some in data.values() for x in some], SCHEMA).repartition(3)
    run = lambda: {r["user_id"]: r["status"] for r in etl.rescale_run(frame(), out, known).collect()}
    read = lambda u: sorted((r["window"], r["t"], r["x"]) for r in spark.read.parquet(out).where(f"user_id = '{u}'").collect())
    assert run() == {"a": "rescaled", "b": "kept", "c": "flagged"}
    assert read("a") == [(w, t, pytest.approx(x / G, abs=1e-6)) for _, w, t, x, _, _ in sorted(data["a"])] and read("b") == [(w, t, x) for _, w, t, x, _, _ in sorted(data["b"])]
    first = files(tmp_path)
    assert run() == dict.fromkeys("abc", "unchanged") and files(tmp_path) == first  # nothing is written
    data["a"] = rows_of("a", G, 2)
    data["d"] = rows_of("d", G, 1)
    assert run() == {"a": "rescaled", "b": "unchanged", "c": "unchanged", "d": "rescaled"}
    later = files(tmp_path)
    kept = {f for f in first if "user_id=b" in f or "user_id=c" in f}
    assert kept and all(later[f] == first[f] for f in kept) and not any("user_id=a" in f and f in first for f in later)
    assert read("a")[0][2] == pytest.approx(sorted(data["a"])[0][3] / G, abs=1e-6)
    del data["b"]
    assert run() == {"a": "unchanged", "c": "unchanged", "d": "unchanged"} and len(read("b")) == 40
    assert {(r["user_id"], r["run"]) for r in etl.manifest(spark, known).collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 2)}


def test_a_run_that_died_is_done_again(spark, tmp_path):
    """The data stand but the manifest has nothing: all is done anew, with the same result."""
    import shutil

    out, known = str(tmp_path / "out"), str(tmp_path / "manifest")
    df = spark.createDataFrame(rows_of("a", G, 1), SCHEMA)
    etl.rescale_run(df, out, known)
    before = sorted(map(tuple, spark.read.parquet(out).collect()))
    shutil.rmtree(known)
    assert [r["status"] for r in etl.rescale_run(df, out, known).collect()] == ["rescaled"]
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before


def test_versions(spark):
    a = spark.createDataFrame(rows_of("a", 1.0, 1) + [("b", None, None, None, None, None), ("b", None, None, None, None, None)], SCHEMA)
    of = lambda d: {r["user_id"]: (r["version"], r["rows"]) for r in etl.versions(d).collect()}
    assert of(a) == of(a.repartition(5)) and of(a)["b"][1] == 2
    assert of(a.where("not (user_id = 'a' and window = 0 and t = 3)"))["a"] != of(a)["a"]
    assert etl.versions(a.limit(0)).count() == 0


def test_a_folder_for_each_run(spark, tmp_path):
    """Many users cost no folders of their own: the manifest tells whose samples are where, and what is read is as by users' folders."""
    data = {f"u{i}": rows_of(f"u{i}", G if i % 2 else 1.0, 1) for i in range(12)}
    frame = lambda: spark.createDataFrame([x for some in data.values() for x in some], SCHEMA).repartition(3)
    both = {f: (str(tmp_path / f / "out"), str(tmp_path / f / "manifest")) for f in ("run", "user_id")}
    run = lambda f: {r["user_id"]: r["status"] for r in etl.rescale_run(frame(), *both[f], folders=f).collect()}
    read = lambda d: sorted(tuple(map(str, r)) for r in d.select("user_id", "window", "t", "x", "y", "z").collect())
    assert run("run") == run("user_id") and sorted(os.listdir(both["run"][0])) == ["run=1"]
    first = files(both["run"][0])
    data["u3"] = rows_of("u3", G, 2)
    assert run("run") == run("user_id") == {u: "rescaled" if u == "u3" else "unchanged" for u in data}
    assert {k: v for k, v in files(both["run"][0]).items() if "run=1" in k} == first
    assert read(etl.rescaled(spark, *both["run"])) == read(spark.read.parquet(both["user_id"][0]))
    with pytest.raises(ValueError):
        etl.rescale_run(frame(), *both["run"], folders="day")
