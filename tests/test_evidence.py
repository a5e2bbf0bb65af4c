"""Evidence of intervals, from segments through cleaning into answers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.operators import resolve, signal_ops
from cadenza.operators import timeline as T

RAW = "user_id long, label int, activity string, start_s double, end_s double, duration_s double, observed_s double, n_segments long"


def joined(rows, gap):
    """Rows (activity, start, end, whose evidence) of which neighbours of one activity become one, by plain reading from first to last."""
    out = []
    for a, s, e, own in rows:
        if out and out[-1][0] == a and s - out[-1][2] <= gap:
            b = out[-1]
            longer = e - s > b[2] - b[1]
            out[-1] = (a, b[1], max(b[2], e), own if longer and own is not None else b[3])
        else:
            out.append((a, s, e, own))
    return out


def cleaned(rows, least, gap):
    rows = joined(rows, gap)
    while len(rows) > 1:
        short = [i for i, r in enumerate(rows) if r[2] - r[1] < least]
        if not short:
            break
        i = min(short, key=lambda k: rows[k][2] - rows[k][1])
        near = [j for j, d in ((i - 1, rows[i][1] - rows[i - 1][2]), (i + 1, rows[i + 1][1] - rows[i][2] if i + 1 < len(rows) else 0)) if 0 <= j < len(rows) and d <= gap]
        if near:
            j = max(near, key=lambda k: rows[k][2] - rows[k][1])
            rows[i] = (rows[j][0], rows[i][1], rows[i][2], None)
            rows = joined(rows, gap)
        else:
            rows.pop(i)
    return [] if len(rows) == 1 and rows[0][2] - rows[0][1] < least else rows


def random_rows(r, n):
    t, out = 0.0, []
    for _ in range(n):
        t += r.choice([0, 0, 10, 50, 150])
        d = r.choice([4, 8, 20, 40, 70, 90, 200])
        out.append((r.choice("ABC"), t, t + d))
        t += d
    return out


def as_raw(spark, users, measured=None):
    rows = [(u, "ABC".index(a), a, s, e, e - s, 4.0, 1, *([m] if measured else [])) for u, some in users.items() for (a, s, e, m) in some]
    return spark.createDataFrame(rows, RAW + (", evidence_of double" if measured else "")).repartition(4)


@pytest.mark.parametrize("given", [False, True])
def test_whose_evidence_stays(spark, given):
    """Both rules against the slow reading, with intervals that have none from the start as well."""
    r = random.Random(3)
    users = {u: [(a, s, e, s if not given or r.random() < 0.6 else None) for a, s, e in random_rows(r, r.randrange(1, 40))] for u in range(60)}
    df = as_raw(spark, users, given)
    got = lambda d: sorted((x["user_id"], x["activity"], x["start_s"], x["end_s"], -1.0 if x["evidence_of"] is None else x["evidence_of"]) for x in d.collect())
    want = lambda f: sorted((u, a, s, e, -1.0 if m is None else m) for u, some in users.items() for a, s, e, m in f(some))
    assert got(T.coalesce_intervals(df, 120)) == want(lambda x: joined(x, 120))
    assert got(T.clean_timeline(df, 60, 120)) == want(lambda x: cleaned(x, 60, 120))


def test_evidence_is_of_the_label(spark):
    """An absorbed interval brings nothing of its own, and the longer of two that it joins gives the evidence."""
    users = {1: [("A", 0.0, 100.0, 0.0), ("B", 100.0, 120.0, 100.0), ("A", 120.0, 400.0, 120.0), ("C", 400.0, 440.0, 400.0)]}
    got = [(x["activity"], x["start_s"], x["end_s"], x["evidence_of"]) for x in T.clean_timeline(as_raw(spark, users), 60, 120).collect()]
    assert got == [("A", 0.0, 440.0, 120.0)]
    e = spark.createDataFrame([(1, 0, 120.0, 1.5), (1, 1, 120.0, 9.0), (1, 0, 0.0, 8.0)], "user_id long, label int, start_s double, acc_mag_mean double")
    (row,) = T.with_evidence(T.clean_timeline(as_raw(spark, users), 60, 120), e).collect()
    assert row["evidence"]["acc_mag_mean"] == 1.5


def segments(spark, n=90):
    rng, rows = np.random.default_rng(2), []
    for u in (1, 2):
        t = 0.0
        for i in range(n):
            t += 4.0 if rng.random() < 0.93 else 300.0
            y = int(rng.integers(0, 2)) if rng.random() < 0.2 else (i // 15) % 2
            x = rng.standard_normal((128, 6)) * (1 + y) + np.array([0, 0, 9.8, 0, 0, 0])
            rows.append((u, t, t + 4.0, i, y, x.ravel().astype(float).tolist()))
    return spark.createDataFrame(rows, "user_id long, t_start double, t_end double, ord long, y int, signal array<float>").repartition(5), rows


def test_evidence_of_a_timeline(spark):
    df, rows = segments(spark)
    iv = {(r["user_id"], r["label"], r["start_s"]): r for r in T.merge_intervals(df, 120, "y").collect()}
    got = signal_ops.timeline_evidence(df, 120, "y").collect()
    assert {(r["user_id"], r["label"], r["start_s"]) for r in got} == set(iv)
    for r in got:
        i = iv[r["user_id"], r["label"], r["start_s"]]
        x = np.array([s for u, a, b, _, _, s in rows if u == r["user_id"] and i["start_s"] <= a and b <= i["end_s"]]).reshape(-1, 128, 6)
        assert len(x) == i["n_segments"]
        want = S.evidence_of(S.evidence_sums(x.astype(np.float32)))
        assert np.isclose(r["acc_mag_mean"], np.linalg.norm(x[..., :3], axis=2).mean(), atol=1e-3)
        assert all(np.isclose(r[k], want[k], atol=2e-4) for k in ("acc_mag_mean", "acc_mag_std", "dynamic_acc_std", "gyro_mag_mean", "gyro_mag_std")) and r["dominant_channel"] == want["dominant_channel"]


def test_answers_quote_evidence(spark):
    iv = spark.createDataFrame([(1, 1, "Sitting", 0.0, 600.0, 600.0, 8.0, 2), (1, 4, "Bicycling", 600.0, 700.0, 100.0, 4.0, 1), (1, 2, "Walking", 700.0, 720.0, 20.0, 4.0, 1), (1, 1, "Sitting", 720.0, 1400.0, 680.0, 4.0, 1), (2, 4, "Bicycling", 0.0, 80.0, 80.0, 4.0, 1)], RAW)
    kind = "user_id long, label int, start_s double, acc_mag_mean double, acc_mag_std double, dynamic_acc_std double, gyro_mag_mean double, gyro_mag_std double, step_freq_hz double, step_freq_share double, gravity_dir array<double>, gravity_mag_g double"
    e = spark.createDataFrame([(1, 1, 0.0, 1.01, 0.02, 0.1, 0.05, 0.2, 1.5, 0.1, [0.0, 0.0, 1.0], 1.0), (1, 1, 720.0, 1.0234, 0.0111, 0.1, 0.06, 0.2, 1.5, 0.2, [0.0, 1.0, 0.0], 1.0), (1, 4, 600.0, 1.2, 0.3, 0.1, 0.75, 0.2, None, None, None, 1.0)], kind)
    asked = ["Was there a prolonged period of sitting?", "Was the user using a wheeled or pedal-based mode of movement?", "When did the user first begin sitting?", "What activity is the user doing at 10 seconds?", "How long was the user sitting?"]
    q = spark.createDataFrame([(f"{u}/{k}", u, t) for u in (1, 2) for k, t in enumerate(asked)], "id string, user_id long, query string")
    out = {r["id"]: r for r in resolve.answer(q, iv, evidence=e).collect()}
    assert out["1/0"]["explanation"] == "A continuous sitting interval of 700 s (700 to 1400 s) exceeds the 480 s (8 min) threshold for a prolonged period, with acceleration magnitude 1.023 ± 0.011 g, gyroscope activity 0.060 rad/s and a periodic component at 1.50 Hz. 2 such intervals were found in total."
    assert out["1/1"]["explanation"] == "1 bicycling episode totalling 100 s were detected; the longest runs 100 s (600 to 700 s), with acceleration magnitude 1.200 ± 0.300 g and gyroscope activity 0.750 rad/s, consistent with sustained pedal-driven movement."
    assert out["2/1"]["explanation"].endswith("(0 to 80 s), consistent with sustained pedal-driven movement.")
    facts = {k: json.loads(out[k]["facts"]).get("intervals") for k in ("1/0", "1/2", "1/3", "1/4", "2/1")}
    assert [f["acc_mag_mean"] for f in facts["1/0"]] == [1.0234, 1.01] and facts["1/0"][0]["gravity_dir"] == [0.0, 1.0, 0.0]
    assert facts["1/2"][0]["acc_mag_mean"] == facts["1/3"][0]["acc_mag_mean"] == 1.01 and facts["1/2"][0]["end_s"] == 600.0
    assert [f["start_s"] for f in facts["1/4"]] == [700.0, 0.0] and "acc_mag_mean" not in facts["2/1"][0]
    plain = {r["id"]: r for r in resolve.answer(q, iv).collect()}
    assert plain["1/0"]["explanation"].endswith("threshold for a prolonged period. 2 such intervals were found in total.")
    assert all(plain[k]["answer"] == out[k]["answer"] and plain[k]["spans"] == out[k]["spans"] for k in out)


def test_signals_that_segments_share(spark):
    """Named signals give what the same signals in each segment give; only names are shuffled with the segments."""
    df, _ = segments(spark)
    signals = df.where("user_id = 1 and ord < 7").select(F.col("ord").alias("name"), "signal")
    named = df.drop("signal").withColumn("name", F.pmod("ord", F.lit(7)))
    got = signal_ops.timeline_evidence(named, 120, "y", signals=signals)
    held = signal_ops.timeline_evidence(named.join(signals, "name"), 120, "y")
    key = lambda r: (r["user_id"], r["label"], r["start_s"])
    got_rows, want = sorted(got.collect(), key=key), sorted(held.collect(), key=key)
    assert len(got_rows) == len(want) > 10 and got.columns == held.columns
    for a, b in zip(got_rows, want, strict=True):
        assert key(a) == key(b) and a["dominant_channel"] == b["dominant_channel"]
        assert all(np.isclose(a[k], b[k], atol=2e-4) for k in ("acc_mag_mean", "acc_mag_std", "dynamic_acc_std", "gyro_mag_mean", "gyro_mag_std", "gravity_mag_g"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "MapInArrow" in plan and "SortMergeJoin" not in plan
