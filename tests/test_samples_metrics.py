import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import etl, metrics, sampling, signal_ops


@pytest.mark.parametrize("have,target,want", [([2, 10, 10], 12, [2, 5, 5]), ([2, 10, 10], 13, [2, 6, 5]), ([0, 3], 10, [0, 3]), ([5], 0, [0])])
def test_water_fill(spark, have, target, want):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(have)], "label int, user_id long, n long")
    assert [r["quota"] for r in sampling.water_fill(df, target).orderBy("user_id").collect()] == want


def test_water_fill_levels(spark):
    r = random.Random(1)
    have = {k: [r.randrange(30) for _ in range(r.randrange(1, 9))] for k in range(40)}
    df = spark.createDataFrame([(k, i, n) for k, v in have.items() for i, n in enumerate(v)], "label int, user_id long, n long")
    got = {}
    for x in sampling.water_fill(df, 50).orderBy("label", "user_id").collect():
        got.setdefault(x["label"], []).append(x["quota"])
    for k, v in have.items():
        level = max(t for t in range(31) if sum(min(n, t) for n in v) <= 50)
        want = [min(n, level) for n in v]
        rest = 50 - sum(want)
        for i, n in enumerate(v):
            if n > level and rest > 0:
                want[i], rest = want[i] + 1, rest - 1
        assert got[k] == want and sum(want) == min(50, sum(v))


@pytest.mark.parametrize("n,q,want", [(10, 4, [0, 3, 6, 9]), (10, 3, [0, 4, 9]), (10, 1, [0]), (5, 9, [0, 1, 2, 3, 4]), (7, 0, [])])
def test_spread_pick(spark, n, q, want):
    df = spark.createDataFrame([(1, i, q) for i in range(n)], "g int, i int, quota int")
    assert [r["i"] for r in sampling.spread_pick(df, "quota", ["g"], ["i"]).orderBy("i").collect()] == want


def test_spread_pick_is_linspace(spark):
    df = spark.range(101).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("i"))
    for q in (2, 7, 33, 100):
        got = [r["i"] for r in sampling.spread_pick(df.withColumn("quota", F.lit(q)), "quota", ["g"], ["i"]).orderBy("i").collect()]
        assert got == np.round(np.linspace(0, 100, q)).astype(int).tolist()


def test_validation_split(spark):
    users = spark.createDataFrame([(0, f"u{i}", {3: 25 + i if i < 4 else 0, 4: 30 if i in (7, 8) else 3}) for i in range(20)], "fold int, user_id string, counts map<int,long>")
    out = sampling.validation_split(users)
    val = {r["user_id"] for r in out.where("part = 'val'").collect()}
    assert len(val) == 8 and {"u0", "u1", "u7", "u8"} <= val


def test_augmentation_plan(spark):
    c = spark.createDataFrame([(0, "a", 10), (0, "b", 10), (1, "a", 1)], "label int, user_id string, n long")
    got = {(r["label"], r["user_id"]): r["copies"] for r in sampling.augmentation_plan(c, cap=50, factor=6.0).collect()}
    assert got == {(0, "a"): 15, (0, "b"): 15, (1, "a"): 5}


def test_overall_metrics(spark):
    r = np.random.default_rng(0)
    cm = r.integers(0, 50, (7, 7))
    cm[5] = 0
    df = spark.createDataFrame([(i, j, int(cm[i, j])) for i in range(7) for j in range(7) if cm[i, j]], "y_true int, y_pred int, n long")
    s, q, tp, n = cm.sum(1), cm.sum(0), cm.diagonal(), cm.sum()
    got = metrics.overall_metrics(df).first()
    ok = s > 0
    acc, chance = tp.sum() / n, (s * q).sum() / n**2
    assert got["accuracy"] == pytest.approx(acc) and got["kappa"] == pytest.approx((acc - chance) / (1 - chance))
    assert got["macro_f1"] == pytest.approx((2 * tp[ok] / (s + q)[ok]).mean()) and got["balanced_accuracy"] == pytest.approx((tp[ok] / s[ok]).mean())
    per = {x["y"]: x for x in metrics.class_metrics(df).collect()}
    assert per[5]["recall"] is None and per[5]["precision"] == 0.0 and per[0]["recall"] == pytest.approx(tp[0] / s[0])


def test_tuning_finds_the_rare_class(spark):
    r = np.random.default_rng(1)
    y = (r.random(400) < 0.1).astype(int)
    p = np.clip(0.2 + 0.25 * y + 0.1 * r.random(400), 0, 1)
    df = spark.createDataFrame([([float(1 - b), float(b)] + [0.0] * 5, int(a)) for a, b in zip(y, p, strict=True)], "probability array<double>, y int")
    w = metrics.tune_thresholds(df)
    pick = (np.column_stack([1 - p, p]) * np.array(w[:2])).argmax(1)
    assert metrics.macro_f1_of(y, pick, 7) > 0.95 > metrics.macro_f1_of(y, np.zeros(400, int), 7)


def test_pareto(spark):
    pts = [(0, 48.7), (942, 39.9), (1917, 39.0), (2944, 39.9), (3240, 50.5), (5886, 50.6)]
    got = metrics.pareto(spark.createDataFrame([(c, g) for c, g in pts], "cost int, gain double"), "cost", "gain").orderBy("cost").collect()
    assert [r["cost"] for r in got] == [0, 3240, 5886]


def test_geometric_mean_and_argmax(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 4.0)], "y int, w double")
    assert metrics.geometric_mean(df).first()["weight"] == pytest.approx(2.0)
    assert spark.range(1).select(metrics.weighted_argmax(F.array(F.lit(0.5), F.lit(0.5)), [1.0, 1.0])).first()[0] == 0


@pytest.mark.parametrize("n,want", [(127, []), (128, [0]), (200, [0, 64]), (256, [0, 64, 128])])
def test_segments(spark, n, want):
    df = spark.createDataFrame([("u", 1, [float(i) for i in range(n)])], "user_id string, window long, x array<double>")
    out = etl.segment(df, ["x"])
    assert [r["seg_start"] for r in out.orderBy("seg_start").collect()] == want
    assert all(len(r["signal"]) == 128 for r in out.collect())
    assert [r["seg_start"] for r in etl.non_overlapping(out).orderBy("seg_start").collect()] == [s for s in want if s % 128 == 0]


def test_labels(spark):
    a = spark.createDataFrame([("u", 1, 1.0, 0.0), ("u", 2, None, math.nan), ("u", 4, 0.0, 0.0)], "user_id string, window long, l1 double, l2 double")
    b = spark.createDataFrame([("u", 2, 1.0), ("u", 3, None)], "user_id string, window long, l3 double")
    got = {r["window"]: r["label"] for r in etl.label_codes(a, b, ["l1", "l2", "l3"]).collect()}
    assert got == {1: 1, 2: 3}
    two = spark.createDataFrame([("u", 1, 1.0)], "user_id string, window long, l3 double")
    with pytest.raises(Exception, match="more than one label"):
        etl.label_codes(a, two, ["l1", "l2", "l3"]).collect()


def test_units(spark):
    rows = [("g", w, 1.0) for w in range(5)] + [("ms", w, 9.8) for w in range(5)] + [("odd", w, 4.0) for w in range(5)]
    s = spark.createDataFrame([(u, w, x, 0.0, 0.0) for u, w, x in rows], "user_id string, window long, x double, y double, z double")
    u = etl.unit_decision(etl.unit_stats(s))
    assert {r["user_id"]: r["unit"] for r in u.collect()} == {"g": "g", "ms": "m/s2", "odd": "inconsistent"}
    assert {r["user_id"]: r["x"] for r in etl.rescale(s, u).collect()}["ms"] == round(9.8 / 9.80665, 6)


def test_asof_against_numpy(spark):
    r = np.random.default_rng(2)
    t, v, q = np.sort(r.random(20)), r.random(20), np.sort(r.random(30))
    left = spark.createDataFrame([(1, float(x)) for x in q], "u int, t double")
    right = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "u int, t double, v double")
    for row in signal_ops.interpolated_asof(left, right, "u", "t", "v").collect():
        if t[0] <= row["t"] <= t[-1]:
            assert row["v"] == pytest.approx(float(np.interp(row["t"], t, v)))
        else:
            assert row["v"] is None
