"""Sources: recorded minutes, label files, timelines, questions and lists of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABEL_COLUMNS = (
    "label:LYING_DOWN", "label:SITTING", "label:FIX_walking", "label:FIX_running", "label:BICYCLING",
    "original_label:STANDING_IN_PLACE", "original_label:STANDING_AND_MOVING",
)  # fixed values: class 1 to class 7


def raw_minutes(spark: SparkSession, path: str) -> DataFrame:
    """<path>/<user>/<epoch>.<anything> of white-space separated t x y z -> user_id, window, pos, t, x, y, z, status.

    A file with any token that is no number is 'unreadable', one with under two rows or four columns 'too_short': such
    a file is one row without samples. Lines are read as text and parsed in expressions; pos is the line's place in its file,
    from the offset-ordered id that one task gives to the lines of a file."""
    lines = spark.read.text(f"{path}/*/*.dat", wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    name = F.regexp_extract("_path", r"([^/]+)/([^/.]+)\.[^/]*$", 1), F.regexp_extract("_path", r"([^/]+)/([^/.]+)\.[^/]*$", 2)
    rows = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cells = F.transform(rows, lambda x: F.split(F.trim(x), r"\s+"))
    number = lambda x: x.try_cast("double")
    files = lines.select(name[0].alias("user_id"), name[1].try_cast("long").alias("window"), cells.alias("_c"))
    bad = F.exists("_c", lambda r: F.exists(r, lambda x: number(x).isNull()))
    short = (F.size("_c") < 2) | (F.size(F.get("_c", F.lit(0))) < 4)
    files = files.withColumn("status", F.when(bad, "unreadable").when(F.coalesce(short, F.lit(True)), "too_short").otherwise("ok"))
    out = files.select("user_id", "window", "status", F.posexplode_outer(F.when(F.col("status") == "ok", F.col("_c"))).alias("pos", "_r"))
    return out.select("user_id", "window", "pos", *[number(F.get("_r", F.lit(i))).alias(c) for i, c in enumerate("txyz")], "status")


def resampled_csv(spark: SparkSession, path: str) -> DataFrame:
    """<path>/<user>/<epoch>.csv with a header timestamp,x,y,z."""
    rows = spark.read.csv(f"{path}/*/*.csv", schema="timestamp double, x double, y double, z double", header=True)
    p = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(p, r"([^/]+)/([^/.]+)\.[^/]*$", 1).alias("user_id"), F.regexp_extract(p, r"([^/]+)/([^/.]+)\.[^/]*$", 2).cast("long").alias("window"), "timestamp", "x", "y", "z")


def label_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Gzipped CSV files of minute labels, one a user -> user_id, window and the columns named."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    have = [F.col(f"`{c}`").try_cast("double").alias(c) for c in columns]
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)\.[^/]*$", 1).alias("user_id"), F.col("timestamp").try_cast("long").alias("window"), *have)


def segments(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def timeline_json(spark: SparkSession, path: str) -> DataFrame:
    """Timeline documents -> intervals."""
    docs = spark.read.json(path, multiLine=True)
    return docs.select(F.col("user").alias("user_id"), F.explode("intervals").alias("i")).select("user_id", "i.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One a line; blank lines and those that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("query")).where("query <> '' and not startswith(query, '#')")
    return rows.withColumn("id", F.monotonically_increasing_id())


def split_arguments(words: list[str]) -> list[str]:
    """Words of a command line to questions: each ends at a word with a question mark; what is left over is one more."""
    out: list[list[str]] = [[]]
    for w in words:
        out[-1].append(w)
        if w.endswith("?"):
            out.append([])
    return [" ".join(q) for q in out if q]


def user_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; a path without files gives none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path).select(F.trim("value").alias("user_id")).where("user_id <> ''").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "user_id string")


def find_user(users: DataFrame, prefix: str, first: bool = False) -> str:
    """The user whose id begins so. None, or more than one unless the first is asked for, is an error that names some."""
    hits = [r["user_id"] for r in users.where(F.col("user_id").startswith(prefix)).select("user_id").distinct().orderBy("user_id").limit(6).collect()]
    if len(hits) == 1 or (first and hits):
        return hits[0]
    near = hits or [r["user_id"] for r in users.select("user_id").distinct().orderBy("user_id").limit(5).collect()]
    raise LookupError(f"{'no' if not hits else 'more than one'} user begins with {prefix!r}: {', '.join(near)}")


def events_as_segments(events: DataFrame) -> DataFrame:
    """Any labelled event table as segments: events (user_id, ts, event_id, event_type) -> user_id, window, seg_index, ord, y; the
    types' places in alphabetical order are the labels."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return events.select("user_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("window"), F.lit(0).alias("seg_index"), F.col("event_id").alias("ord"), (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("y"), "value")


def in_order(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def aligned(predictions: DataFrame, segments: DataFrame, by: list[str], order: list[str], predicted_order: list[str]) -> DataFrame:
    """segments with the predictions' columns, joined by place: the n-th prediction of a group is that of its n-th segment. A group with more of one
    than of the other raises, when rows are read."""
    (a, b), extra = (in_order(segments, by, order), in_order(predictions, by, predicted_order)), [c for c in predictions.columns if c not in segments.columns]
    both = a.withColumn("_left", F.lit(True)).join(b.select(*by, "place", *extra).withColumn("_right", F.lit(True)), [*by, "place"], "full")
    fault = F.raise_error(F.concat(F.lit("predictions and segments differ in number: "), F.concat_ws("/", *[F.col(c).cast("string") for c in by])))
    return both.where(F.when(F.col("_left").isNull() | F.col("_right").isNull(), fault).otherwise(F.lit(True))).drop("_left", "_right", "place")
