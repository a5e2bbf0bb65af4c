"""Signals as DataFrames: resampling, joining of clocks, features, evidence, augmentation and degradation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..schema import SEGMENT, SIX
from ..session import written
from . import timeline as T

#: Segments that one numpy call works on.
AT_ONCE = 2_000


def as_segments(column: pa.Array) -> np.ndarray:
    """An array column of flattened segments (samples x 6) -> (n, samples, 6)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1, len(SIX)) if len(column) else np.zeros((0, SEGMENT, len(SIX)), np.float32)


def arrow_lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n = x.shape[1] if x.ndim > 1 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(x.ravel(), kind))


def changed(rows: DataFrame, signal: str, out: str, kind: str, work) -> DataFrame:
    """Adds an array column computed from the segments; work(segments, batch) gives (n, k)."""
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"`{out}` array<{kind}>"])
    at = rows.columns.index(signal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                values = np.asarray(work(as_segments(b.column(at)), b))
                yield pa.RecordBatch.from_arrays([*b.columns, arrow_lists(values.reshape(b.num_rows, -1), pa.float32() if kind == "float" else pa.float64())], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def with_features(segments: DataFrame, signal: str = "signal") -> DataFrame:
    """Adds features, 213 numbers a segment. Select the rows first: a filter on features can't move below this."""
    return changed(segments, signal, "features", "double", lambda x, _: S.features(x))


def seed_of(*key) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")


def seeds_of(b: pa.RecordBatch, key: list[str], *more) -> list[int]:
    """A seed for each row of a batch, from its key columns."""
    return [seed_of(*more, *k) for k in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in key), strict=True)]


def augmented(segments: DataFrame, key: list[str], seed: int = 0, signal: str = "signal") -> DataFrame:
    """Each segment as it might have been; the random numbers follow from the seed and the row's key, so a repeated task gives the same."""

    return changed(segments, signal, "augmented", "float", lambda x, b: S.augment(x, seeds_of(b, key, seed)))


def degraded(segments: DataFrame, kind: str, level: float, key: list[str], seed: int = 12345, signal: str = "signal") -> DataFrame:
    return changed(segments, signal, "degraded", "float", lambda x, b: S.degrade(x, kind, level, seeds_of(b, key, seed, kind, level)))


def degraded_each(rows: DataFrame, key: list[str], seed: int = 12345, signal: str = "signal") -> DataFrame:
    """As degraded, but by the kind and level that each row names; those of one kind and level in a batch are damaged together."""

    def work(x, b):
        out = np.empty(x.shape, np.float32)
        ways = list(zip(b.column(b.schema.get_field_index("kind")).to_pylist(), b.column(b.schema.get_field_index("level")).to_pylist(), strict=True))
        for kind, level in sorted(set(ways)):
            at = np.array([i for i, w in enumerate(ways) if w == (kind, level)])
            out[at] = S.degrade(x[at], kind, level, seeds_of(b.take(pa.array(at)), key, seed, kind, level))
        return out

    return changed(rows, signal, "degraded", "float", work)


EVIDENCE = "acc_mag_mean double, acc_mag_std double, dynamic_acc_std double, gyro_mag_mean double, gyro_mag_std double, step_freq_hz double, step_freq_share double, gravity_dir array<double>, gravity_mag_g double, dominant_channel string, channel_std map<string,double>"


def interval_evidence(segments: DataFrame, by: list[str], signal: str = "signal", samples: int = SEGMENT) -> DataFrame:
    """What was measured in each interval (the columns `by`). Segments become sums first, which add up by an ordinary
    aggregate, so an interval of any length is never gathered in one place."""
    return evidence_of_sums(segment_sums(segments.select(*by, signal), signal), by, samples)


def segment_sums(segments: DataFrame, signal: str = "signal") -> DataFrame:
    """Adds _sums, what evidence needs of a segment, in place of the signal."""
    return changed(segments, signal, "_sums", "double", lambda x, _: S.evidence_rows(x)).drop(signal)


def timeline_evidence(segments: DataFrame, max_gap_s: float, label: str = "y_smooth", signal: str = "signal", block_s: float = T.BLOCK_S, signals: DataFrame | None = None) -> DataFrame:
    """Evidence of each interval that T.merge_intervals makes of the segments (user_id, t_start, t_end, ord, the label, signal): user_id, label, start_s and the
    measurements. Where intervals begin is found without the signals, which become sums where they are and meet their intervals by the segment's place.

    Segments that share signals name them: `signals` has a column that the segments have too, and the signal. Each signal becomes sums once, and these meet
    segments that have been dealt by interval already, so that only names are shuffled; segments without a signal add nothing."""
    by = ["user_id", "label", "start_s"]
    place = ["user_id", "t_start", "t_end", "ord", F.col(label).cast("int").alias("label")]
    if signals is not None:
        (name,) = [c for c in signals.columns if c != signal]
        sums = written(segment_sums(signals, signal), "signal_sums")
        own = T.islands(segments.select(*place, name), max_gap_s, "label", block_s)
        own = own.select("user_id", "_island", name, "label", F.col("t_start").alias("start_s")).repartition("user_id", "_island")
        return evidence_of_sums(own.join(sums, name), by, group=["user_id", "_island"])
    own = T.islands(segments.select(*place), max_gap_s, "label", block_s)
    own = own.select("user_id", "t_start", "ord", "label", F.min("t_start").over(Window.partitionBy("user_id", "_island")).alias("start_s"))
    sums = segment_sums(segments.select("user_id", "t_start", "ord", signal), signal)
    return evidence_of_sums(sums.join(own, ["user_id", "t_start", "ord"]), by)


def evidence_of_sums(sums: DataFrame, by: list[str], samples: int = SEGMENT, group: list[str] | None = None) -> DataFrame:
    """`group`: what rows are added up by, if it isn't `by`; of each group the least `by` counts."""
    n = 19 + samples // 2 + 1
    own = [F.min(c).alias(f"_by_{c}") for c in by if c not in (group or by)]
    total = sums.groupBy(*(group or by)).agg(*[F.sum(F.col("_sums")[i]).alias(f"_{i}") for i in range(n)], *own)
    total = total.select(*[F.col(c if c in (group or by) else f"_by_{c}").alias(c) for c in by], F.array(*[F.col(f"_{i}") for i in range(n)]).alias("_sums"))
    schema = ", ".join([f"`{c}` {t}" for c, t in total.dtypes if c in by] + [EVIDENCE])
    names = [x.split()[0] for x in EVIDENCE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [S.evidence_of(np.array(s), samples) for s in b.column(len(by)).to_pylist()]
            cols = [pa.array([list(e[k].items()) for e in found], pa.map_(pa.string(), pa.float64())) if k == "channel_std" else pa.array([e[k] for e in found]) for k in names]
            kinds = [pa.float64()] * 7 + [pa.list_(pa.float64()), pa.float64(), pa.string(), pa.map_(pa.string(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], *(c.cast(t) for c, t in zip(cols, kinds, strict=True))], [*by, *names])

    return total.mapInArrow(work, schema)


RESAMPLED = "user_id string, window long, status string, rate_hz double, n_in long, n_out long, t array<double>, x array<double>, y array<double>, z array<double>"


def resample_windows(samples: DataFrame) -> DataFrame:
    """samples (user_id, window, pos, t, x, y, z) of recorded minutes -> one row a minute, on a 32 Hz grid. A minute is a bounded group."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        col = lambda n: table.column(n).to_numpy().astype(float)
        status, rate, used, grid, xyz = S.resample(col("t"), np.column_stack([col("x"), col("y"), col("z")]))
        rows = [[key[0].as_py()], [key[1].as_py()], [status], [None if np.isnan(rate) else float(rate)], [int(used)], [len(grid)], [grid.tolist()], *([xyz[:, i].tolist()] for i in range(3))]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 4)
        return pa.table([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in RESAMPLED.split(", ")])

    out = samples.groupBy("user_id", "window").applyInArrow(work, RESAMPLED)
    six = lambda c: F.transform(c, lambda v: F.bround(v, 6))
    return out.withColumns({c: six(c) for c in ("t", "x", "y", "z")})


MERGED = "user_id string, window long, timestamp array<double>, acc_x array<double>, acc_y array<double>, acc_z array<double>, gyro_x array<double>, gyro_y array<double>, gyro_z array<double>, gyro_extrapolated array<boolean>"


def merge_sensors(acc: DataFrame, gyro: DataFrame) -> DataFrame:
    """Minutes of both sensors (as resample_windows gives them) on the accelerometer's clock; those without a partner, or with under two gyroscope rows, are left out."""
    a = acc.where("n_out >= 1").select("user_id", "window", F.col("t").alias("timestamp"), F.col("x").alias("acc_x"), F.col("y").alias("acc_y"), F.col("z").alias("acc_z"))
    g = gyro.where("n_out >= 2").select("user_id", "window", F.col("t").alias("tg"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    both = a.join(g, ["user_id", "window"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in b.select(["timestamp", "tg", "gx", "gy", "gz"]).to_pylist():
                v, outside = S.onto_clock(np.array(r["tg"]), np.column_stack([r["gx"], r["gy"], r["gz"]]), np.array(r["timestamp"]))
                made.append((*v.T.tolist(), outside.tolist()))
            cols = list(zip(*made, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), *(pa.array(c, pa.list_(pa.float64())) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.bool_()))], [x.split()[0] for x in MERGED.split(", ")])

    return both.mapInArrow(work, MERGED)


def interpolated_asof(left: DataFrame, right: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """left (by, t, ...) with `value` of right (by, t, value) read at its times by linear interpolation; null outside. Both clocks are
    merged and each left row looks back and ahead, so there is no join of ranges and no Python."""
    names = left.columns
    a = left.select("*", F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_tv"), F.lit(1).alias("_own"))
    b = right.select(*[F.col(c) if c in (by, t) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in names], F.col(value).cast("double").alias("_v"), F.col(t).cast("double").alias("_tv"), F.lit(0).alias("_own"))
    w = Window.partitionBy(by).orderBy(t, "_own")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.desc(t), F.desc("_own")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    both = both.withColumns({"_t0": F.last("_tv", True).over(back), "_v0": F.last("_v", True).over(back), "_t1": F.last("_tv", True).over(ahead), "_v1": F.last("_v", True).over(ahead)})
    share = F.try_divide(F.col(t) - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    read = F.when(F.col("_t0") == F.col(t), F.col("_v0")).when(F.col("_t1").isNotNull(), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    return both.withColumn(value, read).where("_own = 1").select(*names, value)


def spectrum_table(segments: DataFrame, key: str, values: str) -> DataFrame:
    """(key, k, power) of de-meaned arrays, by the explicit sums of the discrete Fourier transform: for small arrays, in JVM expressions."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    rows = segments.select(key, F.transform(values, lambda x: x - mean).alias("_d"), n.alias("_n"))
    rows = rows.select(key, "_d", "_n", F.explode(F.sequence(F.lit(1), F.floor(F.col("_n") / 2).cast("int"))).alias("k"))
    turn = lambda i: 2 * np.pi * ((F.col("k") * i) % F.col("_n")) / F.col("_n")
    part = lambda f: F.aggregate(F.transform("_d", lambda x, i: x * f(turn(i))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, "k", (F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2)).alias("power"))
