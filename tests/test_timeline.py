import random

import numpy as np
import pytest

from cadenza.operators import timeline as T

SCHEMA = "user_id long, window long, seg_index int, ord long, y int"


def segs(spark, labels, starts=None, user=1):
    starts = starts or [4 * i for i in range(len(labels))]
    rows = [(user, int(s), 0, i, y) for i, (y, s) in enumerate(zip(labels, starts, strict=True))]
    return T.time_base(spark.createDataFrame(rows, SCHEMA))


def iv(spark, rows):
    """(activity, start, end)"""
    return spark.createDataFrame([(1, 0, a, float(s), float(e), float(e - s), 4.0, 1) for a, s, e in rows], T.CLEANED)


def spans(df):
    return [(r["activity"], r["start_s"], r["end_s"]) for r in sorted(df.collect(), key=lambda r: r["start_s"])]


def test_mode_filter_fixture(spark):
    rows = T.mode_smooth(T.smoothing_runs(segs(spark, [0, 1, 1, 2, 0, 0, 2, 2, 1]), 120)).orderBy("ord").collect()
    assert [r["y_smooth"] for r in rows] == [0, 1, 1, 0, 0, 2, 2, 2, 1]
    assert [r["y_smooth"] for r in T.mode_smooth(T.smoothing_runs(segs(spark, [3]), 120)).collect()] == [3]


@pytest.mark.parametrize("k", [2, 4, 7])
def test_mode_filter_brute_force(spark, k):
    y = [random.Random(k).randrange(4) for _ in range(60)]
    got = [r["y_smooth"] for r in T.mode_smooth(T.smoothing_runs(segs(spark, y), 120), k).orderBy("ord").collect()]
    want = []
    for i, own in enumerate(y):
        near = [y[min(max(j, 0), len(y) - 1)] for j in range(i - k // 2, i - k // 2 + k)]
        most = max(map(near.count, near))
        want.append(own if near.count(own) == most else min(x for x in near if near.count(x) == most))
    assert got == want


def test_two_gap_rules(spark):
    s = segs(spark, [0, 0], [0, 124])
    assert T.smoothing_runs(s, 120).agg({"run": "max"}).first()[0] == 1
    assert spans(T.merge_intervals(s, 120, "y")) == [("Lying down", 0.0, 128.0)]
    assert T.merge_intervals(segs(spark, [0, 0], [0, 125]), 120, "y").count() == 2


def test_short_intervals_are_dropped_without_joining(spark):
    out = T.merge_intervals(segs(spark, [0, 0, 1, 0, 0]), 120, "y", 8.0)
    assert spans(out) == [("Lying down", 0.0, 8.0), ("Lying down", 12.0, 20.0)]
    assert [(r[1], r[2], r[3]) for r in T.transitions(out).collect()] == [("Lying down", "Lying down", 12.0)]


def test_cleaning_fixtures(spark):
    c = lambda rows: spans(T.clean_timeline(iv(spark, rows)))
    assert c([("A", 0, 100), ("B", 100, 130), ("A", 130, 300)]) == [("A", 0, 300)]
    assert c([("A", 0, 100), ("B", 100, 140), ("C", 140, 200)]) == [("A", 0, 140), ("C", 140, 200)]
    assert c([("A", 0, 100), ("B", 500, 520), ("A", 900, 1000)]) == [("A", 0, 100), ("A", 900, 1000)]
    assert c([("A", 0, 30)]) == []
    assert c([]) == []


def slow_clean(rows, least, gap):
    """A plain restatement: look for the shortest again and again."""

    def glue(x):
        out = []
        for a, s, e in x:
            if out and out[-1][0] == a and s - out[-1][2] <= gap:
                out[-1] = (a, out[-1][1], max(e, out[-1][2]))
            else:
                out.append((a, s, e))
        return out

    rows = glue(sorted(rows, key=lambda r: r[1]))
    while True:
        short = [(e - s, s, i) for i, (_, s, e) in enumerate(rows) if e - s < least]
        if not short:
            return rows
        i = min(short)[2]
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and (rows[i][1] - rows[j][2] if j < i else rows[j][1] - rows[i][2]) <= gap]
        if not near:
            rows.pop(i)
        else:
            j = max(near, key=lambda j: rows[j][2] - rows[j][1])
            rows[i] = (rows[j][0], *rows[i][1:])
            rows = glue(rows)


def absorbed(rows):
    a, start, end = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
    label = ["ABC".index(x) for x in a]
    stay = T.absorb(label, start, end, [4.0] * len(rows), [1] * len(rows), list(start), 60, 120)
    return [("ABC"[label[i]], start[i], end[i]) for i in stay]


def test_cleaning_of_many_chains(spark):
    """Users with and without gaps, cleaned as one table, against the slow way; stretches are cut into small batches."""
    r, rows, want = random.Random(5), [], []
    for user in range(40):
        t, mine = 0, []
        for _ in range(r.randrange(1, 60)):
            t += r.choice([0, 10, 150])
            d = r.choice([4, 8, 20, 40, 70, 200])
            mine.append((r.choice("ABC"), t, t + d))
            t += d
        chains = [[]]
        for x in mine:
            if chains[-1] and x[1] - max(y[2] for y in chains[-1]) > 120:
                chains.append([])
            chains[-1].append(x)
        want += [(user, "ABC".index(a), float(s), float(e)) for c in chains for a, s, e in slow_clean(c, 60, 120)]
        rows += [(user, "ABC".index(a), a, float(s), float(e), float(e - s), 4.0, 1) for a, s, e in mine]
    df = spark.createDataFrame(rows, "user_id long, label int, activity string, start_s double, end_s double, duration_s double, observed_s double, n_segments long").repartition(5)
    got = [(x["user_id"], x["label"], x["start_s"], x["end_s"]) for x in T.clean_timeline(df, 60, 120).collect()]
    assert sorted(got) == sorted(want) and T.clean_timeline(df.limit(0), 60, 120).count() == 0


def test_stretches():
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(12), k=200))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7])], ["k"]) for i in range(0, 200, 7)]
    seen = []
    for t, begin in T.stretches(iter(batches), 1, 20):
        parts = np.split(t.column(0).to_numpy(), begin[1:])
        assert all(len(set(p.tolist())) == 1 for p in parts)
        seen += [(int(p[0]), len(p)) for p in parts]
    assert seen == [(k, keys.count(k)) for k in sorted(set(keys))]


def test_cleaning_against_a_slow_one():
    for seed in range(300):
        r, t, rows = random.Random(seed), 0, []
        for _ in range(r.randrange(1, 25)):
            t += r.choice([0, 0, 10, 150])
            d = r.choice([4, 8, 20, 40, 70, 200])
            rows.append((r.choice("ABC"), t, t + d))
            t += d
        # chains are cleaned one by one, as clean_timeline deals them out
        chains = [[]]
        for x in rows:
            if chains[-1] and x[1] - max(y[2] for y in chains[-1]) > 120:
                chains.append([])
            chains[-1].append(x)
        got = []
        for chain in chains:
            got += absorbed(chain)
        want = slow_clean(rows, 60, 120)
        assert got == want
        assert len(chains) > 1 or absorbed(want) == want


def test_viterbi_against_all_sequences():
    import itertools

    r = np.random.default_rng(3)
    for _ in range(10):
        obs = np.log(r.dirichlet(np.ones(3), 6))
        step = lambda a, b: np.log(0.9) if a == b else np.log(0.05)
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(obs[i, s] for i, s in enumerate(p)) + sum(step(a, b) for a, b in itertools.pairwise(p)))
        assert T.viterbi(obs, 0.9).tolist() == list(best)


def test_viterbi_smooth_flattens_a_flicker(spark):
    n = 7
    e = [[0.8 if i == j else 0.2 / (n - 1) for j in range(n)] for i in range(n)]
    out = T.viterbi_smooth(T.smoothing_runs(segs(spark, [1, 1, 1, 2, 1, 1, 1]), 120), e).orderBy("ord").collect()
    assert [r["y_smooth"] for r in out] == [1] * 7


def test_lookups(spark):
    i = iv(spark, [("Walking", 0, 100), ("Sitting", 100, 700)])
    p = spark.createDataFrame([(1, 1, 100.0), (2, 1, 800.0)], "id long, user_id long, time_s double")
    assert {r["id"]: r["activity"] for r in T.at_time(p, i).collect()} == {1: "Walking", 2: None}
    assert {r["id"]: r["activity"] for r in T.nearest(p, i).collect()} == {1: "Walking", 2: "Sitting"}


def test_lookups_by_brute_force(spark):
    """Intervals that touch, overlap by a little and leave gaps; probes at their ends, between and beyond, and of a user without any."""
    r, rows, probes = random.Random(2), [], []
    for user in range(6):
        t = 0
        for _ in range(12):
            t += r.choice([-2, 0, 0, 7, 30])
            t = max(t, 0)
            d = r.choice([5, 10, 40])
            rows.append((user, r.choice(["Walking", "Sitting", "Running"]), float(t), float(t + d)))
            t += d
    for i in range(300):
        probes.append((i, r.randrange(7), float(r.randrange(-10, 320)) / r.choice([1, 2])))
    i = spark.createDataFrame(rows, "user_id long, activity string, start_s double, end_s double")
    p = spark.createDataFrame(probes, "id long, user_id long, time_s double").repartition(3)
    hits = {x["id"]: x for x in T.at_time(p, i).collect()}
    close = {x["id"]: x["activity"] for x in T.nearest(p, i).collect()}
    assert len(hits) == 300
    for k, user, t in probes:
        mine = [x for x in rows if x[0] == user]
        held = min((x for x in mine if x[2] <= t <= x[3]), key=lambda x: x[2], default=None)
        assert (hits[k]["activity"], hits[k]["start_s"]) == ((held[1], held[2]) if held else (None, None))
        best = min(mine, key=lambda x: (-1 if x[2] <= t <= x[3] else min(abs(x[2] - t), abs(x[3] - t)), x[2]), default=None)
        assert close.get(k) == (best[1] if best else None), (k, user, t)
    segments = spark.createDataFrame([(u, float(t), float(t + 4)) for u in range(6) for t in range(0, 200, 3)], "user_id long, t_start double, t_end double")
    got = sorted((x["user_id"], x["start_s"], x["t_start"]) for x in T.held_segments(i, segments, 25.0).collect())
    assert got == sorted((u, s, float(t)) for u, _, s, e in rows for t in range(0, 200, 3) if s <= t and t + 4 <= e)


def test_intervals_of_one_moment(spark):
    """Segments that share a second begin several intervals at once: they follow one another as their segments do, whatever the partitions."""
    s = segs(spark, [2, 0, 2, 0, 0, 1], [0, 0, 0, 0, 50, 50])
    merged = T.merge_intervals(s, 120, "y")
    for n in (1, 3, 7):
        iv = merged.repartition(n, "label", "end_s").sortWithinPartitions("label")
        got = [(r[1], r[2]) for r in sorted(T.transitions(iv).collect(), key=lambda r: r[3])]
        assert got[:3] == [("Walking", "Lying down"), ("Lying down", "Walking"), ("Walking", "Lying down")]
        assert got[3] == ("Lying down", "Sitting") and len(got) == 4
        assert T.coalesce_intervals(iv, 120).count() == 5


def test_lookups_among_intervals_of_one_moment(spark):
    """Of intervals that start and end together the one of the first segment holds the moment, and the earlier onset counts, whatever the partitions."""
    labels = [3, 1, 3, 0, 2, 4]
    s = T.time_base(spark.createDataFrame([(u, 0, 0, i, y) for u in range(40) for i, y in enumerate(labels[u % 6 :] + labels[: u % 6])] + [(u, 50, 0, 6, 1) for u in range(40)], SCHEMA))
    merged = T.merge_intervals(s, 120, "y")
    p = spark.createDataFrame([(u, u, 2.0) for u in range(40)], "id long, user_id long, time_s double")
    for n, by in ((1, "label"), (3, "n_segments"), (5, "ord")):
        i = merged.repartition(n, by).sortWithinPartitions("label")
        first = {u: T.CLASSES[labels[u % 6]] for u in range(40)}
        assert {x["id"]: x["activity"] for x in T.at_time(p, i).collect()} == first
        assert {x["id"]: x["activity"] for x in T.nearest(p, i).collect()} == first
        # of users whose last segment of the moment is Sitting, that interval goes on to 54 and is their only one of it
        onset = {x["user_id"]: x["end_s"] for x in T.onsets(i.where("activity = 'Sitting'")).collect()}
        assert onset == {u: 54.0 if u % 6 == 2 else 4.0 for u in range(40)}
