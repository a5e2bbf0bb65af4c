"""Timelines of one user over many tasks: blocks of any width give what one piece gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import timeline as T

SCHEMA = "user_id string, t_start double, t_end double, ord long, y int"


def users(seed, n=4, rows=70):
    r, out = random.Random(seed), []
    for u in range(n):
        t, y = 0.0, 0
        for i in range(r.randrange(1, rows)):
            t += r.choice([0.0, 4.0, 4.0, 4.0, 60.0, 124.0, 130.0, 900.0]) if i else 0.0
            y = r.randrange(3) if r.random() < 0.5 else y
            out.append((f"u{u}", t, t + 4, u * 1000 + i, y))
    return out


def each_user(rows):
    return {u: sorted((x for x in rows if x[0] == u), key=lambda x: (x[1], x[3])) for u in {x[0] for x in rows}}


@pytest.mark.parametrize("seed,width,block", [(1, 10.0, 2), (2, 100.0, 3), (3, 1e6, 1000), (4, 1.0, 5)])
def test_runs_modes_and_intervals(spark, seed, width, block):
    rows = users(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    run, mode, merged = {}, {}, []
    for u, some in each_user(rows).items():
        number, parts = 0, []
        for i, x in enumerate(some):
            if i and x[1] - some[i - 1][1] > 120:
                number += 1
            run[x[3]] = number
            parts.append((number, x))
        for n in range(number + 1):
            y = [x[4] for k, x in parts if k == n]
            for i, (_, x) in enumerate(p for p in parts if p[0] == n):
                near = [y[min(max(j, 0), len(y) - 1)] for j in range(i - 2, i + 3)]
                most = max(map(near.count, near))
                mode[x[3]] = y[i] if near.count(y[i]) == most else min(v for v in near if near.count(v) == most)
        for i, x in enumerate(some):
            if i and x[4] == merged[-1][1] and x[1] - some[i - 1][2] <= 120:
                merged[-1] = (u, x[4], merged[-1][2], max(x[2], merged[-1][3]), merged[-1][4] + 1)
            else:
                merged.append((u, x[4], x[1], x[2], 1))
    runs = T.smoothing_runs(df, 120, width)
    out = T.mode_smooth(runs, 5, block, width).collect()
    assert {x["ord"]: x["run"] for x in out} == run and {x["ord"]: x["y_smooth"] for x in out} == mode and len(out) == len(rows)
    got = T.merge_intervals(df, 120, "y", block_s=width).collect()
    assert sorted((x["user_id"], x["label"], x["start_s"], x["end_s"], x["n_segments"]) for x in got) == sorted(merged)


def test_time_base_keeps_rows(spark):
    rows = spark.createDataFrame([("a", 100, 1, 1, "x"), ("a", 160, 0, 2, "y"), ("b", 7, 0, 3, None)], "user_id string, window long, seg_index int, ord long, _first string")
    got = {r["ord"]: (r["t_start"], r["t_end"]) for r in T.time_base(rows.drop("_first")).collect()}
    assert got == {1: (4.0, 8.0), 2: (60.0, 64.0), 3: (0.0, 4.0)}


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_decoding_in_blocks(spark, block):
    """From posteriors, against the decoding of each run in one piece; the runs' lengths lie around the block's."""
    r = np.random.default_rng(block)
    rows, want = [], {}
    for u in range(3):
        for run in range(4):
            n = int(r.integers(1, 90))
            p = r.dirichlet(np.full(7, 0.4), n)
            lp = np.log(np.clip(p, 1e-9, None))
            path = T.viterbi(lp, 0.9)
            for i in range(n):
                o = u * 10_000 + run * 1000 + i
                rows.append((f"u{u}", run * 1e5 + 4.0 * i, run * 1e5 + 4.0 * i + 4, o, int(p[i].argmax()), run, lp[i].tolist()))
                want[o] = int(path[i])
    df = spark.createDataFrame(rows, SCHEMA + ", run long, log_proba array<double>").repartition(4)
    out = T.viterbi_smooth(df, None, 0.9, block, 50.0).collect()
    assert {x["ord"]: x["y_smooth"] for x in out} == want and out[0].asDict().keys() == {*df.columns, "y_smooth"}


def test_labels_in_blocks_are_as_likely(spark):
    """From labels, where many paths are equally likely: the path found is none the worse."""
    r = np.random.default_rng(5)
    e = [[0.8 if i == j else 0.2 / 6 for j in range(7)] for i in range(7)]
    y = r.integers(0, 4, 200).tolist()
    df = spark.createDataFrame([("u", 4.0 * i, 4.0 * i + 4, i, v, 0) for i, v in enumerate(y)], SCHEMA + ", run long")
    log_e, follow = np.log(np.array(e)), T.moves(0.95, 7)
    worth = lambda path: log_e[path[0], y[0]] + sum(follow[a, b] + log_e[b, v] for a, b, v in zip(path, path[1:], y[1:], strict=False))
    whole = T.viterbi(log_e[:, y].T, 0.95).tolist()
    got = [x["y_smooth"] for x in T.viterbi_smooth(df, e, 0.95, 16).orderBy("ord").collect()]
    assert np.isclose(worth(got), worth(whole), atol=1e-9)
    assert [x["y_smooth"] for x in T.viterbi_smooth(df, e, 0.95).orderBy("ord").collect()] == whole
    with pytest.raises(ValueError):
        T.viterbi_smooth(df, None)


def test_one_user_is_spread(spark):
    """No task sees more than a small part of a user of 60,000 segments."""
    df = spark.range(60_000, numPartitions=4).select(F.lit("u").alias("user_id"), (F.col("id") * 4.0).alias("t_start"), (F.col("id") * 4.0 + 4).alias("t_end"), F.col("id").alias("ord"), (F.floor(F.col("id") / 50) % 3).cast("int").alias("y"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = T.islands(df, 120, "y", 4_000.0)
        sizes = [r["n"] for r in marked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 1 and max(sizes) < 30_000
        assert marked.agg(F.max("_island")).first()[0] == 1199
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
