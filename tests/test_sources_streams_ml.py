import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ml, signal_ops
from cadenza.sources import readers, sinks
from cadenza.streaming import timeline_stream


def test_raw_minutes(spark, tmp_path):
    for name, text in {"u1/100.m_raw_acc.dat": "1.0 0.1 0.2 0.3\n 1.5  0.1 0.2 0.4 \n", "u1/160.m_raw_acc.dat": "1 2 x 4\n2 3 4 5\n", "u2/100.m_raw_acc.dat": "1 2 3\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = readers.raw_minutes(spark, str(tmp_path)).collect()
    assert {(r["user_id"], r["window"], r["status"]) for r in rows} == {("u1", 100, "ok"), ("u1", 160, "unreadable"), ("u2", 100, "too_short")}
    assert sorted((r["pos"], r["t"], r["z"]) for r in rows if r["status"] == "ok") == [(0, 1.0, 0.3), (1, 1.5, 0.4)]


def test_small_sources(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# no\n\n  How long? \n")
    assert [r["query"] for r in readers.questions(spark, str(tmp_path / "q.txt")).collect()] == ["How long?"]
    assert readers.split_arguments("how long? did she walk".split()) == ["how long?", "did she walk"]
    assert readers.user_list(spark, str(tmp_path / "none.txt")).count() == 0
    users = spark.createDataFrame([("abc",), ("abd",), ("x",)], "user_id string")
    assert readers.find_user(users, "x") == "x" and readers.find_user(users, "ab", first=True) == "abc"
    with pytest.raises(LookupError, match="more than one"):
        readers.find_user(users, "ab")
    with pytest.raises(LookupError, match="no user"):
        readers.find_user(users, "q")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, 0.1234565)], "user_id string, n int, x double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_parquet(df, str(tmp_path / "pq"))
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["x"].startswith("0.12345") and spark.read.parquet(str(tmp_path / "pq")).count() == 1
    assert spark.read.json(str(tmp_path / "json")).first()["n"] == 1
    assert sinks.markdown(df).splitlines()[2] == "| u | 1 | 0.1235 |"


def test_deploy(spark, tmp_path):
    """One call: quotas, features, hours, forest, mean weights and the saved model, which predicts as the fitted one does."""
    r = np.random.default_rng(1)
    wave = lambda y: (np.sin(np.arange(128)[:, None] * (0.1 + 0.3 * y)) + r.normal(0, 0.1, (128, 6))).ravel().tolist()
    rows = [(u, 1_444_000_000 + 60 * i, i, i % 3, wave(i % 3)) for u in range(3) for i in range(30 if u else 60)] + [(0, 1, 0, None, wave(0))]
    df = spark.createDataFrame(rows, "user_id long, window long, seg_index int, label int, signal array<double>")
    model, about = ml.deploy(df, [[1.0] * 7, [4.0, 1.0, 0.25] + [1.0] * 4], str(tmp_path / "m"), cap=24, trees=10, depth=5)
    # 24 of each class by equal quotas: eight of each user
    assert about["train_per_class"] == [24] * 3 + [0] * 4 and about["n_train"] == 72 and about["n_features"] == 215 and about["nodes"] > 10
    assert about["weights"] == pytest.approx([2.0, 1.0, 0.5, 1, 1, 1, 1])
    again, kept = sinks.load_model(str(tmp_path / "m"))
    assert kept == about
    seen = ml.with_time(signal_ops.with_features(df.where("label is not null")))
    got = [sorted((x["user_id"], x["window"], x["y_pred"]) for x in ml.predict(seen, m, about["weights"]).select("user_id", "window", "y_pred").collect()) for m in (model, again)]
    assert got[0] == got[1] and ml.predict(seen, again, kept["weights"]).where("label = y_pred").count() > 110
    with pytest.raises(ValueError):
        ml.deploy(df.limit(0), [[1.0] * 7], str(tmp_path / "n"))
    with pytest.raises(ValueError):
        ml.mean_weights([[1.0, 0.0], [1.0, 1.0]])


def test_forest(spark, tmp_path):
    r = random.Random(0)
    rows = [(u, 1_444_000_000 + 60 * i, y := r.randrange(3), [y + r.gauss(0, 0.3), r.gauss(0, 1)]) for u in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, window long, y int, features array<double>")
    model = ml.fit(ml.with_time(df), ml.forest(trees=10, depth=5))
    out = ml.predict(ml.with_time(df), model)
    assert out.where("y = y_pred").count() > 150 and all(len(x["probability"]) == 7 for x in out.limit(3).collect())
    sinks.save_model(model, str(tmp_path / "m"), [1.0] * 7, True, 4)
    again, about = sinks.load_model(str(tmp_path / "m"))
    assert about["use_time"] and ml.predict(ml.with_time(df), again).where("y = y_pred").count() == out.where("y = y_pred").count()
    two = ml.predict_two_stage(df, ml.fit_two_stage(df, lambda: ml.forest(trees=8, depth=5)))
    assert two.where("y = y_pred").count() > 140
    z = ml.per_user(df).groupBy("user_id").agg(F.avg(F.col("features")[0]).alias("m")).collect()
    assert all(abs(x["m"]) < 1e-5 for x in z)


def test_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "user_id long, ts timestamp, y int"
    for k, rows in enumerate([[(1, at(0), 1), (1, at(4), 1), (1, at(8), 2)], [(1, at(12), 2), (1, at(1000), 2)], [(1, at(90_000), 3)], [(1, at(200_000), 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = timeline_stream.stream_intervals(stream()).writeStream.format("memory").queryName("iv").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["label"], r["n_segments"], r["end_s"] - r["start_s"]) for r in spark.table("iv").collect())
    assert got[:3] == [(1, 2, 8.0), (2, 1, 4.0), (2, 2, 8.0)]
    q = timeline_stream.stream_runs(stream()).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("runs").collect())[-1] == 4


def test_forest_query_takes_all_labels(spark, tmp_path, monkeypatch):
    from cadenza.plans import queries

    r, made, forest = random.Random(6), [], ml.forest
    rows = [(i, [float(x) for x in [r.gauss(i % 10, 0.1) for _ in range(64)]], i % 10) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(ml, "forest", lambda **k: made.append(forest(**k)) or made[-1])
    got = queries.rf_predict(spark, str(tmp_path)).collect()
    assert sorted(x["vec_id"] for x in got) == list(range(80))
    assert {x["y"] for x in got} == {x["y_pred"] for x in got} == set(range(10))
    assert [(m.getNumTrees(), m.getMaxDepth()) for m in made] == [(200, 20)]
    b = ml.boosting()
    assert (b.rounds, b.rate, b.leaves, b.least_leaf, b.l2, b.hold_one_in, b.patience) == (400, 0.08, 63, 100, 1.0, 10, 20)
