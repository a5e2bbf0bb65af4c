"""Quotas, systematic samples, splits and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def water_fill(available: DataFrame, target: int, by: str = "label", key: str = "user_id", n: str = "n") -> DataFrame:
    """Adds quota: every key of a group gives the same number, as far as it has that many, so that the group gives `target` if it can. What
    is left over goes, one each, to the first keys that have more.

    With the keys in order of what they have, the level is found by a running sum: it lies at the first key from which on
    an equal share of the rest fits all."""
    w = Window.partitionBy(by).orderBy(n, key)
    rank, count = F.row_number().over(w), F.count("*").over(Window.partitionBy(by))
    below = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = available.withColumn("_rest", count - rank + 1).withColumn("_level", F.floor((F.lit(target) - below) / F.col("_rest")))
    first = F.min(F.when(F.col("_level") < F.col(n), F.struct(rank.alias("r"), F.col("_level").alias("l")))).over(Window.partitionBy(by))
    rows = rows.withColumn("_rank", rank).withColumn("_first", first)
    rows = rows.withColumn("_base", F.when(F.col("_first").isNull(), F.col(n)).otherwise(F.least(F.col(n), F.col("_first.l"))))
    given = F.sum("_base").over(Window.partitionBy(by))
    more = F.col(n) > F.col("_base")
    order = F.sum(more.cast("int")).over(Window.partitionBy(by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_extra", (more & (order <= F.lit(target) - given)).cast("long"))
    return rows.select(*available.columns, (F.col("_base") + F.col("_extra")).cast("long").alias("quota"))


def spread_pick(rows: DataFrame, quota: str, by: list[str], order: list[str]) -> DataFrame:
    """Of each group's rows, as many as its quota says, evenly spread from the first to the last; half places go to the even one."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    q = F.least(F.col(quota), F.col("_n"))
    # the places near i are those of the picks around i * (q - 1) / (n - 1)
    guess = F.floor(F.col("_i") * (q - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    place = lambda k: F.bround(k * (F.col("_n") - 1) / (q - 1), 0)
    near = F.exists(F.array(guess - 1, guess, guess + 1), lambda k: (k >= 0) & (k < q) & (place(k) == F.col("_i")))
    keep = F.when(q <= 0, False).when(q == 1, F.col("_i") == 0).otherwise(near)
    return ranked.where(keep).drop("_i", "_n")


def class_distribution(segments: DataFrame, label: str = "label") -> DataFrame:
    return segments.groupBy(label).agg(F.count("*").alias("rows"), F.countDistinct("user_id", "window").alias("windows"), F.countDistinct("user_id").alias("users"))


def training_set(segments: DataFrame, cap: int = 120_000) -> DataFrame:
    """At most `cap` real segments of each class, by equal quotas of users, evenly spread over each user's recording."""
    quota = water_fill(segments.groupBy("label", "user_id").agg(F.count("*").alias("n")), cap).select("label", "user_id", "quota")
    return spread_pick(segments.join(quota, ["label", "user_id"]), "quota", ["label", "user_id"], ["window", "seg_index"]).drop("quota")


def augmentation_plan(counts: DataFrame, cap: int = 50_000, factor: float = 6.0, key: str = "user_id") -> DataFrame:
    """counts (label, user_id, n of real segments): how many copies each user's segments get so that a class reaches the smaller of `cap` and `factor` times
    its real number, dealt round by round over the users."""
    w = Window.partitionBy("label")
    real = F.sum("n").over(w)
    want = F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(real * factor)) - real)
    users, rank = F.count("*").over(w), F.row_number().over(w.orderBy(key))
    return counts.withColumn("copies", (F.floor(want / users) + (rank <= want % users).cast("int")).cast("long"))


def balanced_fold(segments: DataFrame, splits: DataFrame, cap: int = 50_000, factor: float = 6.0, thinned: tuple[int, ...] = (1, 2), seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """segments (user_id, window, seg_index, seg_start, label, signal) and splits (user_id, part) of one fold -> (training rows with `copy`, 0 for real
    ones; channel statistics of the real ones; validation and test rows with their part).

    Segments of the thinned classes don't overlap. Each class has at most `cap` real segments, by equal quotas of users; one that has fewer gets
    changed copies up to the smaller of `cap` and `factor` times its number, dealt round by round over its segments user by user. Validation and test
    keep their natural shares, without overlap."""
    from . import etl, signal_ops

    parts = segments.join(splits.select("user_id", "part"), "user_id")
    real = training_set(etl.non_overlapping(parts.where("part = 'train'"), classes=thinned), cap)
    w = Window.partitionBy("label")  # at most `cap` rows
    have, rank = F.count("*").over(w), F.row_number().over(w.orderBy("user_id", "window", "seg_index"))
    want = F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(have * factor)) - have)
    copies = (F.floor(want / have) + (rank <= want % have).cast("int")).cast("int")
    planned = real.withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    made = signal_ops.augmented(planned, ["user_id", "window", "seg_index", "copy"], seed).drop("signal").withColumnRenamed("augmented", "signal")
    train = real.withColumn("copy", F.lit(0)).unionByName(made).orderBy(F.xxhash64(F.lit(seed), "user_id", "window", "seg_index", "copy"))
    return train, etl.channel_stats(real), etl.non_overlapping(parts.where("part <> 'train'"))


def replayed(chosen: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """The training rows of a replayed choice against stored ones (key, label, user_id): rows of either that the other lacks or labels otherwise. A
    faithful replay gives no row."""
    a, b = (x.select(*key, F.col("label").alias(n)) for x, n in ((chosen, "label"), (stored, "stored_label")))
    return a.join(b, key, "full").where(~F.col("label").eqNullSafe(F.col("stored_label")))


def validation_split(users: DataFrame, n_val: int = 8, rare: tuple[int, ...] = (3, 4), per_rare: int = 2, least: int = 20, seed: int = 1000) -> DataFrame:
    """users (fold, user_id, counts map<int,long>) of the training part -> part: 'val' for n_val users of each fold, 'train' for the others.

    For each rare class the `per_rare` users with the fewest segments, of those with at least `least`, come first; the rest by a seeded hash.
    There are tens of users in a fold; the order is by expressions all the same."""
    out = users.withColumn("_pick", F.lit(0))
    for c in rare:
        have = F.coalesce(F.try_element_at("counts", F.lit(c)), F.lit(0))
        some = (F.row_number().over(Window.partitionBy("fold").orderBy(F.when(have >= least, 0).otherwise(1), have, "user_id")) <= per_rare) & (have >= least)
        out = out.withColumn("_pick", F.greatest("_pick", some.cast("int")))
    w = Window.partitionBy("fold").orderBy(F.desc("_pick"), F.xxhash64("user_id", F.col("fold") + seed), "user_id")
    return out.withColumn("part", F.when(F.row_number().over(w) <= n_val, "val").otherwise("train")).drop("_pick")


def split_checks(splits: DataFrame) -> DataFrame:
    """splits (fold, part, user_id): users in two parts of one fold, and users not tested exactly once. Good splits give no row."""
    twice = splits.groupBy("fold", "user_id").agg(F.countDistinct("part").alias("n")).where("n > 1").select(F.lit("in two parts").alias("fault"), "user_id")
    tested = splits.groupBy("user_id").agg(F.count_if(F.col("part") == "test").alias("n")).where("n <> 1").select(F.lit("not tested once").alias("fault"), "user_id")
    return twice.unionByName(tested)


def fold_coverage(splits: DataFrame, segments: DataFrame, label: str = "label", watched: int = 3) -> DataFrame:
    """Users and segments of each part, their shares in percent (one decimal), and segments of the watched class."""
    per_user = segments.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col(label) == watched).alias("watched"))
    part = splits.join(per_user, "user_id").groupBy("fold", "part").agg(F.count("*").alias("users"), F.sum("n").alias("segments"), F.sum("watched").alias("watched"))
    w = Window.partitionBy("fold")
    return part.withColumn("user_share", F.round(100 * F.col("users") / F.sum("users").over(w), 1)).withColumn("segment_share", F.round(100 * F.col("segments") / F.sum("segments").over(w), 1))
