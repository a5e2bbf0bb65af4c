import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import development as D
from cadenza.operators import etl, sampling
from cadenza.sources import readers

NAMES = ("Lying down", "Sitting", "Walking", "Bicycling")


def timeline(spark, seed, users=5):
    r, rows = random.Random(seed), []
    for u in range(users):
        t = 0.0
        for _ in range(r.randrange(1, 14)):
            t += r.choice([0, 30, 400])
            d = float(r.choice([40, 90, 500, 900]))
            rows.append((u, r.choice(NAMES), t, t + d, d))
            t += d
    return spark.createDataFrame(rows, "user_id long, activity string, start_s double, end_s double, duration_s double"), rows


@pytest.mark.parametrize("seed", range(3))
def test_questions_are_true_and_answered_so(spark, seed):
    """Over the timeline that they come from, all questions are answered by their true answers."""
    iv, rows = timeline(spark, seed)
    q = D.generate(iv, seed=seed)
    asked = q.collect()
    assert len({x["id"] for x in asked}) == len(asked)
    for u in {x[0] for x in rows}:
        mine = [x for x in asked if x["user_id"] == u]
        present = {x[1] for x in rows if x[0] == u}
        kinds = {k: [x for x in mine if x["type"] == k] for k in ("identification", "verification", "duration", "count", "grounding", "comparison", "open_world")}
        assert len(kinds["identification"]) == len(kinds["verification"]) == 6 and len(kinds["open_world"]) == 3
        assert len(kinds["duration"]) == len(kinds["count"]) == len(kinds["grounding"]) == len(present)
        assert {x["true_answer"] for x in kinds["verification"]} == ({"Yes", "No"} if len(present) > 1 else {"Yes"})
        total = {a: sum(x[4] for x in rows if x[0] == u and x[1] == a) for a in present}
        assert {(x["activity_event"], x["numeric"]) for x in kinds["duration"]} == set(total.items())
        for x in kinds["comparison"]:
            a, b = x["activity_event"].split(", ")
            assert total[a] != total[b] and x["true_answer"] == max(a, b, key=total.get)
    # moments are shown as whole seconds, which may round into a neighbour: those aside, all agree
    said = {x["id"]: x for x in D.answer(q, iv).collect()}
    assert said.keys() == {x["id"] for x in asked}
    for x in asked:
        if x["type"] not in ("identification", "verification"):
            assert (said[x["id"]]["answer"], said[x["id"]]["activity_event"]) == (x["true_answer"], x["activity_event"]), x
    moments = [x for x in asked if x["type"] in ("identification", "verification")]
    assert sum(said[x["id"]]["answer"] == x["true_answer"] for x in moments) >= 0.9 * len(moments)


def test_the_nearest_interval_answers(spark):
    iv = spark.createDataFrame([(1, "Walking", 100.0, 200.0, 100.0), (1, "Sitting", 400.0, 900.0, 500.0)], "user_id long, activity string, start_s double, end_s double, duration_s double")
    q = spark.createDataFrame(
        [("a", 1, "identification", "What activity is the user performing at 260 seconds?", "x"), ("b", 1, "identification", "What activity is the user performing at 390 seconds?", "x"), ("c", 2, "identification", "What activity is the user performing at 5 seconds?", "x"), ("d", 1, "verification", "Is the user sitting at 2000 seconds?", "Sitting"), ("e", 2, "open_world", D.PROLONGED, "-")],
        "id string, user_id long, type string, query string, activity_event string",
    )
    assert {r["id"]: r["answer"] for r in D.answer(q, iv).collect()} == {"a": "Walking", "b": "Sitting", "c": "N/A", "d": "Yes", "e": "No"}
    assert D.generate(iv.limit(0)).count() == 0 and D.answer(q.limit(0), iv).count() == 0


def test_places_must_match(spark):
    a = spark.createDataFrame([(1, i, i * 2) for i in range(5)] + [(2, 0, 9)], "user_id long, ord long, y long")
    b = spark.createDataFrame([(1, i + 100, i) for i in range(5)] + [(2, 7, 7)], "user_id long, at long, p long")
    got = readers.aligned(b, a, ["user_id"], ["ord"], ["at"]).collect()
    assert sorted((x["user_id"], x["ord"], x["p"]) for x in got) == [(1, i, i) for i in range(5)] + [(2, 0, 7)]
    with pytest.raises(Exception, match="differ in number"):
        readers.aligned(b.where("at <> 7"), a, ["user_id"], ["ord"], ["at"]).collect()


def test_blocks_follow_changes(spark):
    windows = [5, 5, 6, 6, 6, 5, 7]
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(windows)], "user_id long, pos long, window long")
    assert [x["block"] for x in etl.contiguous_blocks(rows, ["pos"]).orderBy("pos").collect()] == [0, 0, 1, 1, 1, 2, 3]


def test_a_fold_is_balanced(spark):
    import numpy as np

    r = np.random.default_rng(0)
    rows = [(u, w, s, s * 64, label, r.normal(size=768).tolist()) for u in range(6) for w, label in enumerate([0, 0, 1, 3]) for s in range(4)]
    seg = spark.createDataFrame(rows, "user_id long, window long, seg_index int, seg_start int, label int, signal array<float>")
    splits = spark.createDataFrame([(u, "train" if u < 4 else "val" if u == 4 else "test") for u in range(6)], "user_id long, part string")
    train, stats, rest = sampling.balanced_fold(seg, splits, cap=24, factor=2.0)
    n = {(x["label"], x["copy"] > 0): x["count"] for x in train.groupBy("label", "copy").count().groupBy("label", "copy").agg(F.sum("count").alias("count")).collect()}
    real = {k: sum(x["count"] for x in train.where("copy = 0").groupBy("label").count().collect() if x["label"] == k) for k in (0, 1, 3)}
    assert real == {0: 24, 1: 8, 3: 16}  # 32 capped; 16 thinned to those that don't overlap; 16
    made = {x["label"]: x["count"] for x in train.where("copy > 0").groupBy("label").count().collect()}
    assert made == {1: 8, 3: 8} and n
    assert train.where("size(signal) <> 768").count() == 0 and len(stats.first()["stats"]) == 6
    assert {x["part"]: x["count"] for x in rest.groupBy("part").count().collect()} == {"val": 8, "test": 8}
    spread = [x["count"] for x in train.where("copy > 0 and label = 3").groupBy("user_id").count().collect()]
    assert max(spread) <= 4
    again = sampling.replayed(train.where("copy = 0"), train.where("copy = 0"), ["user_id", "window", "seg_index"])
    assert again.count() == 0


def test_overhead(spark):
    scored = spark.createDataFrame([("rules", "count", True), ("rules", "count", False), ("rules", "duration", True)], "name string, type string, correct boolean")
    parsed = spark.createDataFrame([("rules", "count", "count"), ("rules", "duration", "count")], "name string, type string, intent string")
    timings = spark.createDataFrame([("rules", 2.0, 10.0), ("rules", 4.0, 10.0)], "name string, ms double, watts double")
    sizes = spark.createDataFrame([("rules", 0, 0.0, 1.0)], "name string, params long, size_mb double, peak_mb double")
    x = D.overhead(scored, parsed, timings, sizes).first()
    assert (x["accuracy"], x["agreement"], x["median_ms"], x["joules"]) == (0.75, 0.5, 3.0, 0.03)


def test_labels_of_the_model(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "label int")
    values = lambda df: sorted((x["label"] for x in etl.to_model_labels(df).collect()), key=lambda x: (x is not None, x))
    assert values(of(1, 7, 3, None)) == [None, 0, 2, 6] and values(of(0, 6)) == [0, 6] and values(of()) == []
    for bad in ((1, 8), (-1, 3)):
        with pytest.raises(Exception, match="labels must lie"):
            values(of(*bad))


def test_sweep_with_questions(spark):
    """All levels in one plan: damage is what `degraded` does, and questions are answered over each level's own timeline."""
    from cadenza.operators import questions, signal_ops
    from cadenza.operators import timeline as T
    from cadenza.session import written

    r, rows = random.Random(2), []
    for u in (3, 8):
        for i in range(120):
            y = [1, 2, 0, 4][i // 30]
            rows.append((u, 1000 + 4 * i, 0, i, y, [r.gauss(0, 1) for _ in range(768)]))
    df = spark.createDataFrame(rows, "user_id long, window long, seg_index int, ord long, y int, signal array<float>").repartition(3)
    levels = {"noise": [0.0, 2.0], "rate": [8.0]}
    seen = {}

    def predict(f):
        seen["columns"] = f.columns
        return f.withColumn("y_pred", F.when((F.col("kind") == "noise") & (F.col("level") == 0), F.col("y")).when(F.col("kind") == "rate", F.lit(1)).otherwise(F.when(F.col("y") == 4, 2).otherwise(F.col("y"))))

    iv = written(T.clean_timeline(T.build(df.drop("signal"))), "true")
    q = written(questions.generate(iv), "questions")
    out = {(x["kind"], x["level"]): x for x in D.robustness(df, levels, ["user_id", "ord"], predict, D.question_scores(q, 3)).collect()}
    assert "features" in seen["columns"] and set(out) == {("noise", 0.0), ("noise", 2.0), ("rate", 8.0)}
    best, some, worst = out["noise", 0.0], out["noise", 2.0], out["rate", 8.0]
    assert best["accuracy"] == 1.0 and some["accuracy"] == 0.75 and worst["accuracy"] == 0.25
    assert best["qa_macro"] > some["qa_macro"] > worst["qa_macro"] and best["qa_per_type"]["duration"] == 1.0
    from cadenza.operators import resolve, scoring

    said = resolve.answer(q.select("id", "user_id", "query"), T.build(df.drop("signal"))).select("id", "answer", "spans", "modality", "channels")
    direct = {x["type"]: x["accuracy"] for x in scoring.aggregate(scoring.score(q.join(said, "id"))).collect() if x["type"]}
    assert best["qa_per_type"] == pytest.approx(direct) and best["qa_macro"] == pytest.approx(sum(direct.values()) / len(direct))
    each = signal_ops.degraded_each(df.withColumn("kind", F.when(F.col("ord") % 2 == 0, "rate").otherwise("dropout")).withColumn("level", F.lit(10.0)), ["user_id", "ord"])
    plain = signal_ops.degraded(df.where("ord % 2 = 1"), "dropout", 10.0, ["user_id", "ord"])
    of = lambda d: {(x["user_id"], x["ord"]): x["degraded"] for x in d.where("ord % 2 = 1").collect()}
    assert of(each) == of(plain)
