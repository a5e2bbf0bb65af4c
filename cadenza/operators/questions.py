"""Benchmark questions with true answers from a timeline, for all users in one job. Choices follow from a seeded hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import whole
from ..schema import CLASSES, DYNAMIC, GERUND, STATIC
from .timeline import onsets, totals

# --- fixed values: wording of the questions --------------------------------------------------------
VERBS = {"Lying down": "lie down", "Sitting": "sit", "Walking": "walk", "Running": "run", "Bicycling": "cycle", "Standing in place": "stand in place", "Standing and moving": "stand and move"}
WORDING = {
    "identification": ("What activity is the user performing at {t} seconds?", "What was the user doing at {t} seconds?", "Which activity was happening at {t} seconds from the start?"),
    "verification": ("Is the user {g} at {t} seconds?", "Was the user {g} at {t} seconds?"),
    "duration": ("How long was the user {g}?", "What was the total time the user spent {g}?", "How much time did the user spend {g} in total?"),
    "count": ("How many separate times did the user {v}?", "How many times did the user {v} during the recording?", "How often did the user {v}?"),
    "comparison": ("Did the user spend more time {g} or {h}?", "Which took longer overall, {g} or {h}?"),
    "grounding": ("Did the user begin {g} at any point, and if so, when?", "When did the user first start {g}?"),
    "prolonged": ("Did the user {v} for a prolonged period?", "Was there a long stretch of {g}?"),
}
# ---------------------------------------------------------------------------------------------------
PROLONGED_CHOICES = ("Lying down", "Sitting", "Walking", "Standing in place")


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def worded(kind: str, seed: int, key: Column, **parts: Column) -> Column:
    """One of the kind's wordings, chosen by hash, with its parts filled in."""
    options = WORDING[kind]
    out = F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), key), F.lit(len(options))) + 1).cast("int"))
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def drawn(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)


def generate(intervals: DataFrame, seed: int = 7, prolonged_s: float = 480.0) -> DataFrame:
    """Cleaned true intervals -> id, user_id, type, query, true_answer, activity, true_spans, numeric.

    Of each user: 5 moments to identify, 6 to verify (every other one wrongly named), up to 4 durations, counts and
    comparisons of unequal totals, 3 onsets and one of an activity that never occurs, 2 questions for prolonged
    activity, one for wheeled movement and one for the overall level."""
    span = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    iv = intervals.select("user_id", "activity", "start_s", "end_s", "duration_s", span.alias("span"))
    spans = iv.groupBy("user_id", "activity").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("duration_s") >= prolonged_s, F.col("span")))).alias("long"))
    t = totals(intervals).join(spans, ["user_id", "activity"]).join(onsets(intervals).withColumnRenamed("end_s", "onset_end"), ["user_id", "activity"])
    g, v = lookup(GERUND, F.col("activity")), lookup(VERBS, F.col("activity"))
    share = F.pmod(F.xxhash64(F.lit(seed), "user_id", "start_s", "_n"), F.lit(10_000)) / 10_000
    moment = F.col("start_s") + share * (F.col("end_s") - F.col("start_s"))
    none = F.lit(None).cast("array<struct<start:double,end:double>>")
    shape = lambda df, kind, query, answer, activity, true_spans, numeric: df.select("user_id", F.lit(kind).alias("type"), query.alias("query"), answer.alias("true_answer"), activity.alias("activity"), true_spans.alias("true_spans"), numeric.cast("double").alias("numeric"))
    out = []
    key = F.concat_ws("/", "user_id", "start_s")
    some = drawn(iv, 5, seed, "start_s").withColumn("m", moment)
    out.append(shape(some, "identification", worded("identification", seed, key, t=whole(F.col("m"))), F.col("activity"), F.col("activity"), F.array("span"), F.lit(None)))
    some = drawn(iv, 6, seed + 1, "start_s").withColumn("m", moment)
    others = F.filter(F.array(*map(F.lit, CLASSES)), lambda c: c != F.col("activity"))
    wrong = F.element_at(others, (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(CLASSES) - 1)) + 1).cast("int"))
    some = some.withColumn("asked", F.when(F.col("_n") % 2 == 1, F.col("activity")).otherwise(wrong))
    yes = F.col("asked") == F.col("activity")
    out.append(shape(some, "verification", worded("verification", seed, key, g=lookup(GERUND, F.col("asked")), t=whole(F.col("m"))), F.when(yes, "Yes").otherwise("No"), F.col("asked"), F.when(yes, F.array("span")), F.lit(None)))
    name = F.concat_ws("/", "user_id", "activity")
    out.append(shape(drawn(t, 4, seed + 2, "activity"), "duration", worded("duration", seed, name, g=g), F.concat(whole(F.col("total_s")), F.lit(" seconds")), F.col("activity"), F.col("spans"), F.col("total_s")))
    out.append(shape(drawn(t, 4, seed + 3, "activity"), "count", worded("count", seed, name, v=v), F.col("n_intervals").cast("string"), F.col("activity"), none, F.col("n_intervals")))
    b = t.select("user_id", F.col("activity").alias("other"), F.col("total_s").alias("other_s"))
    pairs = t.join(b, "user_id").where("activity < other and total_s <> other_s")  # at most 21 a user
    out.append(shape(drawn(pairs, 4, seed + 4, "activity", "other"), "comparison", worded("comparison", seed, F.concat_ws("/", name, "other"), g=g, h=lookup(GERUND, F.col("other"))), F.when(F.col("total_s") > F.col("other_s"), F.col("activity")).otherwise(F.col("other")), F.concat_ws(", ", "activity", "other"), none, F.lit(None)))
    out.append(shape(drawn(t, 3, seed + 5, "activity"), "grounding", worded("grounding", seed, name, g=g), F.lit("Yes"), F.col("activity"), F.array(F.struct(F.col("onset_s").alias("start"), F.col("onset_end").alias("end"))), F.col("onset_s")))
    users = t.groupBy("user_id").agg(F.collect_set("activity").alias("have"), F.sum(F.when(F.col("activity").isin(*STATIC), F.col("total_s")).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("activity").isin(*DYNAMIC), F.col("total_s")).otherwise(0.0)).alias("d"))
    absent = users.select("user_id", F.explode(F.array_except(F.array(*map(F.lit, CLASSES)), "have")).alias("activity"))
    out.append(shape(drawn(absent, 1, seed + 6, "activity"), "grounding", worded("grounding", seed, name, g=g), F.lit("No"), F.col("activity"), none, F.lit(None)))
    asked = users.select("user_id", F.explode(F.array(*map(F.lit, PROLONGED_CHOICES))).alias("activity"))
    asked = drawn(asked, 2, seed + 7, "activity").join(t.select("user_id", "activity", "long"), ["user_id", "activity"], "left")
    has = F.coalesce(F.size("long"), F.lit(0)) > 0
    out.append(shape(asked, "open_world", worded("prolonged", seed, name, v=v, g=g), F.when(has, "Yes").otherwise("No"), F.concat(F.lit("Prolonged "), F.lower("activity")), F.when(has, F.col("long")), F.lit(None)))
    cycled = users.join(t.where("activity = 'Bicycling'").select("user_id", "spans"), "user_id", "left")
    out.append(shape(cycled, "open_world", F.lit("Was the user using a wheeled or pedal-based mode of movement?"), F.when(F.col("spans").isNotNull(), "Yes").otherwise("No"), F.lit("Bicycling"), F.col("spans"), F.lit(None)))
    out.append(shape(users, "open_world", F.lit("Was the user mostly at rest or mostly physically active?"), F.when(F.col("s") >= F.col("d"), "Mostly at rest").otherwise("Mostly physically active"), F.lit("Overall activity level"), none, F.lit(None)))
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("id", F.concat_ws("_", F.col("user_id").cast("string"), "type", F.hex(F.xxhash64("query", "activity"))))


def oracle_intent(questions: DataFrame) -> DataFrame:
    """Perfect parsing: intent and activities as the question was made, the moment from its text."""
    from ..functions.scalar import seconds_in

    names = F.filter(F.transform(F.split("activity", ", "), lambda a: F.trim(a)), lambda a: a.isin(*CLASSES))
    open_name = F.when(F.col("type") == "open_world", F.filter(F.array(*map(F.lit, CLASSES)), lambda c: F.lower("activity").contains(F.lower(c)))).otherwise(names)
    return questions.withColumns({"intent": F.col("type"), "activities": open_name, "time_s": seconds_in(F.col("query"))})
