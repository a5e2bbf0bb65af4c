"""The development round: a plain question set from a true timeline, its answers straight from a predicted one, and sweeps over damaged signals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import seconds_in, whole
from ..schema import DYNAMIC, NA, STATIC, TimelineConfig
from ..session import written
from . import metrics, resolve, scoring, signal_ops
from .timeline import build, nearest_interval

# --- fixed values: the wordings of the development questions and of their answers --------------------
IDENTIFICATION = "What activity is the user performing at {t} seconds?"
VERIFICATION = "Is the user {a} at {t} seconds?"
DURATION = "How long was the user {a}?"
COUNT = "How many separate times did the user {a} during the recording?"
COMPARISON = "Did the user spend more time {a} or {b}?"
GROUNDING = "Did the user begin {a} at any point, and if so, when?"
ONSET = "Yes, {a} began at {t} seconds"
PROLONGED = "Did the user lie down for a prolonged period?"
WHEELED = "Was the user using a wheeled or pedal-based mode of movement?"
OVERALL = "Was the user mostly at rest or mostly physically active?"
CYCLING = "Unknown outdoor physical activity, consistent with cycling"
# ---------------------------------------------------------------------------------------------------
SPANS = "array<struct<start:double,end:double>>"


def filled(text: str, **parts: Column) -> Column:
    out = F.lit(text)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def chance(seed: int, *key: str) -> Column:
    """Between 0 and 1, from the seed and the row's key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 20)) / (1 << 20)


def facts(intervals: DataFrame, prolonged_s: float) -> DataFrame:
    """user_id, activity with totals, all spans in order, the first three that are prolonged, and the first of all."""
    span = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    long = F.slice(F.array_sort(F.collect_list(F.when(F.col("duration_s") >= prolonged_s, span))), 1, 3)
    return intervals.groupBy("user_id", "activity").agg(F.round(F.sum("duration_s"), 1).alias("total_s"), F.count("*").alias("n"), F.array_sort(F.collect_list(span)).alias("spans"), long.alias("long"), F.min(span).alias("first"))


def generate(intervals: DataFrame, n_per_type: int = 6, seed: int = 0, prolonged_s: float = 480.0, min_episode_s: float = 60.0) -> DataFrame:
    """Cleaned true intervals -> id, user_id, type, query, true_answer, activity_event, true_spans, numeric.

    Of each user: n_per_type moments to identify and as many to verify (every other one by another activity of the user, if there is
    one), durations, counts and onsets of the first n_per_type activities by name, as many comparisons of unequal totals, and three questions about
    behaviour. Draws are by hash, with replacement, so users are drawn side by side."""
    t = facts(intervals, prolonged_s)
    number = Window.partitionBy("user_id").orderBy("start_s", "activity")
    iv = intervals.select("user_id", "activity", "start_s", "end_s", F.row_number().over(number).alias("_i"), F.count("*").over(Window.partitionBy("user_id")).alias("_of"))
    users = iv.where("_i = 1").select("user_id", "_of")
    shape = lambda df, kind, query, answer, event, spans, numeric=None: df.select("user_id", F.lit(kind).alias("type"), query.alias("query"), answer.alias("true_answer"), event.alias("activity_event"), (F.lit(None) if spans is None else spans).cast(SPANS).alias("true_spans"), (F.lit(None) if numeric is None else numeric).cast("double").alias("numeric"), (F.col("_k") if "_k" in df.columns else F.lit(0)).alias("_k"))

    def moments(salt: int) -> DataFrame:
        drawn = users.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_per_type - 1))))
        drawn = drawn.withColumn("_i", (F.floor(chance(seed + salt, "user_id", "_k") * F.col("_of")) + 1).cast("int")).drop("_of")
        at = F.col("start_s") + chance(seed + salt + 1, "user_id", "_k") * (F.col("end_s") - F.col("start_s"))
        return drawn.join(iv.drop("_of"), ["user_id", "_i"]).withColumn("_t", whole(at))

    low = F.lower("activity")
    own = F.array(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end")))
    out = [shape(moments(10), "identification", filled(IDENTIFICATION, t=F.col("_t")), F.col("activity"), F.col("activity"), own)]
    present = t.groupBy("user_id").agg(F.array_sort(F.collect_list("activity")).alias("_have"))
    asked = moments(20).join(present, "user_id").withColumn("_others", F.filter("_have", lambda a: a != F.col("activity")))
    other = F.get("_others", F.floor(chance(seed + 22, "user_id", "_k") * F.size("_others")).cast("int"))
    asked = asked.withColumn("_a", F.when((F.col("_k") % 2 == 0) | (F.size("_others") == 0), F.col("activity")).otherwise(other))
    yes = F.col("_a") == F.col("activity")
    out.append(shape(asked, "verification", filled(VERIFICATION, a=F.lower("_a"), t=F.col("_t")), F.when(yes, "Yes").otherwise("No"), F.col("_a"), F.when(yes, own)))
    some = t.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy("activity"))).where(F.col("_k") <= n_per_type)
    out.append(shape(some, "duration", filled(DURATION, a=low), F.concat(whole(F.col("total_s")), F.lit(" seconds")), F.col("activity"), F.col("spans"), F.col("total_s")))
    out.append(shape(some, "count", filled(COUNT, a=low), F.col("n").cast("string"), F.col("activity"), None, F.col("n")))
    out.append(shape(some, "grounding", filled(GROUNDING, a=low), filled(ONSET, a=low, t=whole(F.col("first.start"))), F.col("activity"), F.array("first"), F.col("first.start")))
    b = t.select("user_id", F.col("activity").alias("_b"), F.col("total_s").alias("_bs"))
    pairs = t.join(b, "user_id").where("activity < _b and total_s <> _bs")  # at most 21 a user
    pairs = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.xxhash64(F.lit(seed + 30), "activity", "_b"), "activity", "_b"))).where(F.col("_k") <= n_per_type)
    out.append(shape(pairs, "comparison", filled(COMPARISON, a=low, b=F.lower("_b")), F.when(F.col("total_s") > F.col("_bs"), F.col("activity")).otherwise(F.col("_b")), F.concat_ws(", ", "activity", "_b"), None))
    people = users.select("user_id")
    behaved = behaviour(people, t, intervals, prolonged_s, min_episode_s)
    out.append(behaved.select("user_id", F.lit("open_world").alias("type"), "query", F.col("answer").alias("true_answer"), "activity_event", F.col("spans").alias("true_spans"), F.lit(None).cast("double").alias("numeric"), "_k"))
    return reduce(DataFrame.unionByName, out).withColumn("id", F.concat_ws("_", F.col("user_id").cast("string"), "type", F.col("_k").cast("string"))).drop("_k")


def behaviour(users: DataFrame, t: DataFrame, intervals: DataFrame, prolonged_s: float, min_episode_s: float) -> DataFrame:
    """The three questions about behaviour, answered: user_id, query, answer, activity_event, spans, _k."""
    none = F.lit(None).cast(SPANS)
    total = lambda names: F.coalesce(F.sum(F.when(F.col("activity").isin(*names), F.col("total_s"))), F.lit(0.0))
    lying = F.max(F.when(F.col("activity") == "Lying down", F.col("long")))
    span = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    rides = intervals.where((F.col("activity") == "Bicycling") & (F.col("duration_s") >= min_episode_s)).groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(span)), 1, 3).alias("_rides"))
    each = users.join(t.groupBy("user_id").agg(lying.alias("_long"), total(STATIC).alias("_s"), total(DYNAMIC).alias("_d")), "user_id", "left").join(rides, "user_id", "left")
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rest = F.coalesce(F.col("_s") >= F.col("_d"), F.lit(True))
    rows = F.array(
        F.struct(F.lit(PROLONGED).alias("query"), F.when(has("_long"), "Likely yes").otherwise("No").alias("answer"), F.lit("Prolonged lying down").alias("activity_event"), F.when(has("_long"), F.col("_long")).otherwise(none).alias("spans"), F.lit(1).alias("_k")),
        F.struct(F.lit(WHEELED).alias("query"), F.when(has("_rides"), "Yes").otherwise("No").alias("answer"), F.when(has("_rides"), CYCLING).otherwise(NA).alias("activity_event"), F.when(has("_rides"), F.col("_rides")).otherwise(none).alias("spans"), F.lit(2).alias("_k")),
        F.struct(F.lit(OVERALL).alias("query"), F.when(rest, "Mostly at rest").otherwise("Mostly physically active").alias("answer"), F.lit("Overall activity level").alias("activity_event"), none.alias("spans"), F.lit(3).alias("_k")),
    )
    return each.select("user_id", F.explode(rows).alias("_r")).select("user_id", "_r.*")


def answer(questions: DataFrame, intervals: DataFrame, prolonged_s: float = 480.0, min_episode_s: float = 60.0) -> DataFrame:
    """questions (id, user_id, type, query, activity_event) answered from predicted intervals without any parsing: id, type, query, answer, event, spans.

    Type and activity are read from the question's truth; a moment that no interval holds is answered by the nearest one."""
    t = facts(intervals, prolonged_s)
    q = questions.select("id", "user_id", "type", "query", "activity_event")
    names = F.transform(F.split("activity_event", ","), lambda a: F.trim(a))
    q = q.withColumns({"_a": F.get(names, F.lit(0)), "_b": F.get(names, F.lit(1)), "time_s": seconds_in(F.col("query"))})
    timed = q.where("type in ('identification', 'verification')").select("id", "user_id", "time_s").where("time_s is not null")
    hit = nearest_interval(timed, intervals).select("id", F.col("activity").alias("_hit"), F.array(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"))).alias("_span"))
    mine = t.select("user_id", F.col("activity").alias("_a"), "total_s", "n", "spans", "first")
    other = t.select("user_id", F.col("activity").alias("_b"), F.col("total_s").alias("_bs"))
    people = q.where("type = 'open_world'").select("user_id").distinct()
    behaved = behaviour(people, t, intervals, prolonged_s, min_episode_s).select("user_id", "query", F.col("answer").alias("_said"), F.col("activity_event").alias("_event"), F.col("spans").alias("_seen"))
    q = q.join(hit, "id", "left").join(mine, ["user_id", "_a"], "left").join(other, ["user_id", "_b"], "left").join(behaved, ["user_id", "query"], "left")
    kind = lambda k: F.col("type") == k
    yes = F.coalesce(F.col("_hit") == F.col("_a"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    said = (
        F.when(kind("identification"), F.coalesce("_hit", F.lit(NA)))
        .when(kind("verification"), F.when(yes, "Yes").otherwise("No"))
        .when(kind("duration"), F.concat(whole(zero(F.col("total_s"))), F.lit(" seconds")))
        .when(kind("count"), F.coalesce("n", F.lit(0)).cast("string"))
        .when(kind("comparison"), F.when(zero(F.col("total_s")) >= zero(F.col("_bs")), F.col("_a")).otherwise(F.col("_b")))
        .when(kind("grounding"), F.when(F.col("first").isNull(), "No").otherwise(filled(ONSET, a=F.lower("_a"), t=whole(F.col("first.start")))))
        .otherwise(F.col("_said"))
    )
    event = F.when(kind("identification"), said).when(kind("open_world"), F.col("_event")).otherwise(F.col("activity_event"))
    spans = (
        F.when(kind("identification"), F.col("_span"))
        .when(kind("verification"), F.when(yes, F.col("_span")))
        .when(kind("duration") | kind("count"), F.col("spans"))
        .when(kind("grounding"), F.when(F.col("first").isNotNull(), F.array("first")))
        .when(kind("open_world"), F.col("_seen"))
    )
    return q.select("id", "user_id", "type", "query", said.alias("answer"), event.alias("activity_event"), spans.cast(SPANS).alias("spans"))


def robustness(segments: DataFrame, levels: dict[str, list[float]], key: list[str], predict: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """kind, level, accuracy, macro_f1 and what `ask` adds: segments (signal, y, ...) damaged by each kind and level, described, and classified.

    Each segment is read once and goes on once for each level; `predict` takes all these rows with their features and adds y_pred. `ask` takes them (with
    _level, the level's number, but without signals) to a row for each _level, see question_scores."""
    grid = [(kind, float(level)) for kind, some in levels.items() for level in some]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), F.lit(kind).alias("kind"), F.lit(level).alias("level")) for i, (kind, level) in enumerate(grid)]))
    rows = segments.withColumn("_l", each).select(*segments.columns, "_l.*")
    damaged = signal_ops.degraded_each(rows, key).drop("signal").withColumnRenamed("degraded", "signal")
    seen = written(predict(signal_ops.with_features(damaged)).drop("signal", "features", "probability"), "seen")
    cm = metrics.confusion(seen, "y", "y_pred", "_level", "kind", "level")
    out = metrics.overall_metrics(cm, "_level", "kind", "level").select("_level", "kind", "level", "accuracy", "macro_f1")
    return (out if ask is None else out.join(ask(seen), "_level", "left")).drop("_level")


def question_scores(questions: DataFrame, n_levels: int, config: TimelineConfig = TimelineConfig()) -> Callable[[DataFrame], DataFrame]:
    """What robustness may ask: questions (as questions.generate makes them, with their truth) answered over the timeline of each level's labels; qa_macro, the mean over
    types of the share that is right, and qa_per_type. Users have whole numbers; a user at a level is a user of its own, so all levels are answered in one go."""

    def ask(seen: DataFrame) -> DataFrame:
        own = (F.col("user_id") * n_levels + F.col("_level")).cast("long")
        iv = written(build(seen.select(own.alias("user_id"), "window", "seg_index", "ord", F.col("y_pred").alias("y")), config), "level_intervals")
        q = questions.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1)))).withColumn("user_id", own).withColumn("id", F.concat_ws("/", "id", "_level"))
        q = written(q, "level_questions")
        said = resolve.answer(q.select("id", "user_id", "query"), iv, config).select("id", "answer", "spans", "modality", "channels")
        per = scoring.score(q.join(said, "id")).groupBy("_level", "type").agg(F.avg(F.col("correct").cast("double")).alias("share"))
        return per.groupBy("_level").agg(F.avg("share").alias("qa_macro"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "share")))).alias("qa_per_type"))

    return ask


def overhead(scored: DataFrame, parsed: DataFrame, timings: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each parser (name): scored (name, type, ...), parsed (name, type, intent), timings (name, ms, watts), sizes (name, params, size_mb,
    peak_mb) -> params, size_mb, peak_mb, median_ms, joules, share of intents that were read rightly, and mean accuracy over the types."""
    by_type = scored.groupBy("name", "type").agg(F.avg(F.col("correct").cast("double")).alias("a"))
    macro = by_type.groupBy("name").agg(F.avg("a").alias("accuracy"))
    agree = parsed.groupBy("name").agg(F.avg((F.col("type") == F.col("intent")).cast("double")).alias("agreement"))
    return sizes.join(scoring.latency(timings), "name", "left").join(agree, "name", "left").join(macro, "name", "left").select("name", "params", "size_mb", "peak_mb", "median_ms", "joules", "agreement", "accuracy")
