"""From raw samples and minute labels to labelled segments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import magnitude, to_g
from ..schema import GRAVITY, SEGMENT
from ..session import written


def valid_samples(samples: DataFrame) -> DataFrame:
    """Finite rows with t > 0; of equal times in a minute the first by position."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    w = Window.partitionBy("user_id", "window", "t").orderBy("pos")
    return samples.where(finite("t") & finite("x") & finite("y") & finite("z") & (F.col("t") > 0)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unit_stats(samples: DataFrame) -> DataFrame:
    """Per user: median over minutes of the median magnitude, and the shares of minutes that look like g and like m/s2."""
    minute = samples.groupBy("user_id", "window").agg(F.percentile(magnitude(F.col("x"), F.col("y"), F.col("z")), 0.5).alias("m"))
    share = lambda lo, hi: F.avg(((F.col("m") > lo) & (F.col("m") < hi)).cast("double"))
    return minute.groupBy("user_id").agg(F.percentile("m", 0.5).alias("median_mag"), share(0.5, 2.0).alias("in_g"), share(0.5 * GRAVITY, 2.0 * GRAVITY).alias("in_ms2"))


def unit_decision(stats: DataFrame, least: float = 0.80) -> DataFrame:
    return stats.withColumn("unit", F.when(F.col("in_ms2") >= least, "m/s2").when(F.col("in_g") >= least, "g").otherwise("inconsistent"))


def rescale(samples: DataFrame, units: DataFrame) -> DataFrame:
    """In g: samples of users who recorded m/s2 are divided and rounded to six decimals."""
    rows = samples.join(units.select("user_id", "unit"), "user_id", "left")
    return rows.withColumns({c: F.when(F.col("unit") == "m/s2", to_g(F.col(c), GRAVITY)).otherwise(F.col(c)) for c in ("x", "y", "z")})


MANIFEST = "user_id string, version string, rows long, unit string, median_mag double, run long"


def versions(samples: DataFrame) -> DataFrame:
    """user_id, version, rows: equal samples of a user, in whatever order, have one version."""
    at = F.xxhash64("window", "x", "y", "z").cast("decimal(38,0)")
    minutes = samples.groupBy(F.col("user_id").cast("string").alias("user_id"), "window").agg(F.sum(at).alias("_s"), F.count("*").alias("_n"))
    sums = [F.sum(c).cast("string") for c in (F.col("_s"), F.xxhash64("window", "_s", "_n").cast("decimal(38,0)"), F.col("_n"))]
    return minutes.groupBy("user_id").agg(F.sha2(F.concat_ws("/", *sums), 256).alias("version"), F.sum("_n").alias("rows"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What was rescaled last of each user; without a manifest an empty table."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "user_id"]), "run").alias("_m")).select("user_id", "_m.*")


def rescale_run(samples: DataFrame, path: str, manifest_path: str, least: float = 0.80, folders: str = "user_id") -> DataFrame:
    """Rescale what has changed: user_id, status (rescaled, kept, flagged or unchanged), unit, median_mag of each user of the samples.

    Users whose samples have the version that the manifest has for them are unchanged: nothing of theirs is written. The others' folders at `path` (by
    user_id) are replaced: in g where they recorded m/s2 (rescaled), as they are where they recorded g (kept) or no unit fits (flagged). The manifest gets
    their rows when all folders stand, so a run that dies is done again by the next. Users who are no longer among the samples stay as they are. Two runs at once aren't
    provided for.

    A folder for each user costs the driver some calls for each: with many users name folders="run". What a run writes is then one folder, the manifest says which
    run has a user's last samples, and `rescaled` reads these."""
    if folders not in ("user_id", "run"):
        raise ValueError("folders: user_id or run")
    spark = samples.sparkSession
    samples = samples.withColumn("user_id", F.col("user_id").cast("string")).where("user_id is not null")
    before = written(manifest(spark, manifest_path), "manifest")
    now = versions(samples)
    due = written(now.join(before.select("user_id", "version"), ["user_id", "version"], "left_anti"), "due")
    users = due.join(unit_decision(unit_stats(samples.join(due.select("user_id"), "user_id", "left_semi")), least).select("user_id", "unit", "median_mag"), "user_id", "left")
    users = written(users, "due_users")
    if users.isEmpty():
        done = users
    else:
        rows = rescale(samples.join(users.select("user_id"), "user_id", "left_semi"), users).drop("unit")
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        out = rows.write.mode("overwrite").option("compression", "zstd")
        if folders == "run":
            out.parquet(f"{path}/run={run}")
        else:
            out.option("partitionOverwriteMode", "dynamic").partitionBy("user_id").parquet(path)
        done = users.withColumn("run", F.lit(run).cast("long"))
        done.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.mode("append").parquet(manifest_path)
    status = F.when(F.col("unit") == "m/s2", "rescaled").when(F.col("unit") == "g", "kept").otherwise("flagged")
    same = before.join(now.select("user_id", "version"), ["user_id", "version"], "left_semi").select("user_id", F.lit("unchanged").alias("status"), "unit", "median_mag")
    return done.select("user_id", status.alias("status"), "unit", "median_mag").unionByName(same)


def rescaled(spark: SparkSession, path: str, manifest_path: str) -> DataFrame:
    """The last samples of each user that runs with folders="run" have written."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("run", F.col("run").cast("long"))
    return rows.join(manifest(spark, manifest_path).select("user_id", "run"), ["user_id", "run"], "left_semi").drop("run")


def label_codes(one: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Two label tables on (user_id, window), each with some of the columns -> label, 1 for the first column. A label is on above 0.5; null or
    NaN is off; rows without a label go; two labels at once raise."""
    both = one.join(other, ["user_id", "window"], "full")
    on = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) > 0.5 for c in columns])
    count = F.size(F.filter(on, lambda x: x))
    checked = F.when(count > 1, F.raise_error(F.lit("more than one label in a minute"))).otherwise(F.array_position(on, True))
    return both.select("user_id", "window", checked.cast("int").alias("label")).where("label > 0")


def label_rows(samples: DataFrame, codes: DataFrame) -> DataFrame:
    """Samples of labelled minutes. A minute has one code, so this is an equi-join; Spark broadcasts the codes while they are small."""
    return samples.join(codes, ["user_id", "window"])


def to_model_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """1..7 to 0..6; what is already 0..6 (it has a 0) stays; anything else raises, when rows are read."""
    ends = F.broadcast(rows.agg(F.min(label).alias("_least"), F.max(label).alias("_most")))  # one row
    fault = F.raise_error(F.lit("labels must lie in 1..7")).cast("int")
    own = F.col(label).cast("int")
    value = F.when(F.col("_least") == 0, own).when((F.col("_least") >= 1) & (F.col("_most") <= 7), own - 1).when(F.col("_least").isNotNull(), fault)
    return rows.crossJoin(ends).withColumn(label, value).drop("_least", "_most")


def segment(windows: DataFrame, signals: list[str], length: int = SEGMENT, stride: int = SEGMENT // 2) -> DataFrame:
    """Rows (user_id, window, arrays of one length each) -> seg_start, seg_index and a flattened signal (sample by sample). Tails go."""
    n = F.size(signals[0])
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    rows = windows.withColumn("seg_start", F.explode(starts))
    cut = F.arrays_zip(*[F.slice(c, F.col("seg_start") + 1, F.lit(length)).alias(c) for c in signals])
    flat = F.flatten(F.transform(cut, lambda s: F.array(*[s[c].cast("float") for c in signals])))
    keep = [c for c in windows.columns if c not in signals]
    return rows.select(*keep, "seg_start", (F.col("seg_start") / stride).cast("int").alias("seg_index"), flat.alias("signal"))


def contiguous_blocks(rows: DataFrame, order: list[str], window: str = "window") -> DataFrame:
    """rows (user_id, window, ...) with block: a new one begins wherever the window changes in the user's order of rows, so that a window that
    comes back later is another block and no segment spans what lies between."""
    w = Window.partitionBy("user_id").orderBy(*order)
    new = F.coalesce((F.col(window) != F.lag(window).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def most_extrapolated(stats: DataFrame, n: int = 5) -> DataFrame:
    """The n users (a report) with the largest share of continued gyroscope rows, of merge_stats."""
    share = F.col("extrapolated") / F.col("rows")
    return stats.where("rows > 0").withColumn("share", share).orderBy(F.desc("share"), "user_id").limit(n)


def segment_ids(segments: DataFrame) -> DataFrame:
    return segments.withColumn("seg_id", F.row_number().over(Window.partitionBy("user_id").orderBy("window", "seg_start")) - 1)


def non_overlapping(segments: DataFrame, length: int = SEGMENT, classes: tuple[int, ...] | None = None) -> DataFrame:
    whole = F.col("seg_start") % length == 0
    return segments.where(whole if classes is None else whole | ~F.col("label").isin(*classes))


def channel_stats(segments: DataFrame, channels: int = 6) -> DataFrame:
    """Mean and population deviation (+1e-8) of each channel over flattened signals; one row."""
    rows = segments.select(F.posexplode("signal").alias("i", "v")).groupBy((F.col("i") % channels).alias("channel")).agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-8).alias("std"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("stats"))


def normalise(segments: DataFrame, stats: DataFrame, channels: int = 6) -> DataFrame:
    """Signals less the mean over the deviation of their channel, by statistics of real training rows."""
    s = lambda i: F.col("stats")[(i % channels).cast("int")]
    return segments.crossJoin(F.broadcast(stats)).withColumn("signal", F.transform("signal", lambda v, i: ((v - s(i)["mean"]) / s(i)["std"]).cast("float"))).drop("stats")  # one row


def user_znorm(rows: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """Each column less its user's mean, over the larger of its user's population deviation and `floor`."""
    w = Window.partitionBy("user_id")
    return rows.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(floor)) for c in columns})


def is_wall_clock(segments: DataFrame, since: int = 946_684_800) -> DataFrame:
    return segments.groupBy("user_id").agg(F.bool_and(F.col("window") > since).alias("wall_clock"))


def status_counts(windows: DataFrame, hz: float = 32.0) -> DataFrame:
    """Per status: minutes, and minimum, median and maximum rate, and the share in percent below `hz`."""
    return windows.groupBy("status").agg(F.count("*").alias("n"), F.min("rate_hz").alias("low"), F.percentile("rate_hz", 0.5).alias("mid"), F.max("rate_hz").alias("high"), (100 * F.avg((F.col("rate_hz") < hz).cast("double"))).alias("below"))


def merge_stats(merged: DataFrame, acc: DataFrame) -> DataFrame:
    """Per user: merged minutes and rows, continued rows, largest magnitude of read and of continued gyroscope values, and accelerometer minutes without a partner."""
    each = merged.select("user_id", "window", F.explode(F.arrays_zip("gyro_x", "gyro_y", "gyro_z", "gyro_extrapolated")).alias("r"))
    size = magnitude(F.col("r.gyro_x"), F.col("r.gyro_y"), F.col("r.gyro_z"))
    made = F.col("r.gyro_extrapolated")
    out = each.groupBy("user_id").agg(F.countDistinct("window").alias("windows"), F.count("*").alias("rows"), F.count_if(made).alias("extrapolated"), F.max(F.when(~made, size)).alias("max_read"), F.max(F.when(made, size)).alias("max_extrapolated"))
    alone = acc.join(merged.select("user_id", "window"), ["user_id", "window"], "left_anti").groupBy("user_id").agg(F.count("*").alias("skipped_no_gyro"))
    return out.join(alone, "user_id", "full").na.fill(0, ["windows", "rows", "extrapolated", "skipped_no_gyro"])


def count_check(source: DataFrame, output: DataFrame) -> DataFrame:
    """Rows by user in both tables, with match, MISMATCH or missing."""
    a, b = source.groupBy("user_id").agg(F.count("*").alias("n_source")), output.groupBy("user_id").agg(F.count("*").alias("n_output"))
    both = a.join(b, "user_id", "full")
    return both.withColumn("check", F.when(F.col("n_output").isNull() | F.col("n_source").isNull(), "missing").when(F.col("n_source") == F.col("n_output"), "match").otherwise("MISMATCH"))
