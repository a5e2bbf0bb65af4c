"""Answers to parsed questions over timelines, as joins: any number of questions and users are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import Parser, has_any, parse
from ..functions.scalar import evidence_text, span_text, whole
from ..schema import CHANNELS, DYNAMIC, MODALITY, NA, PROLONGED_WORDS, STATIC, WHEELED_WORDS, TimelineConfig
from ..session import written
from .timeline import at_time, clean_timeline, in_time, ranked_spans, totals, with_evidence

SPAN = "struct<start:double,end:double>"
#: Of what was measured in an interval (see signal_ops.EVIDENCE), what facts and explanations quote.
QUOTED = ("acc_mag_mean", "acc_mag_std", "dynamic_acc_std", "gyro_mag_mean", "gyro_mag_std", "step_freq_hz", "step_freq_share", "gravity_dir")
MEASURED = "struct<" + ",".join(f"{f}:{'array<double>' if f == 'gravity_dir' else 'double'}" for f in QUOTED) + ">"


def cited(intervals: DataFrame, top: int = 3) -> DataFrame:
    """user_id, activity, spans: the longest first, and how many last long enough to be prolonged is left to the caller."""
    ranked = ranked_spans(intervals, top)
    return ranked.groupBy("user_id", "activity").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("start_s").alias("start"), F.col("end_s").alias("end")))).alias("_s")).select("user_id", "activity", F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def by_activity(intervals: DataFrame, prolonged_s: float) -> DataFrame:
    """What any answer needs of a user's activity, from one pass: totals, onset, longest spans, and how many last long enough to be prolonged."""
    w = Window.partitionBy("user_id", "activity").orderBy(F.desc("duration_s"), "start_s")
    ranked = intervals.withColumn("_rank", F.row_number().over(w))
    own = F.col("evidence") if "evidence" in intervals.columns else F.lit(None).cast(MEASURED)
    own = F.struct(*[own[f].alias(f) for f in QUOTED])
    first = F.struct(*in_time(intervals))
    span = F.when(F.col("_rank") <= 3, F.struct("_rank", F.col("start_s").alias("start"), F.col("end_s").alias("end"), own.alias("e")))
    out = ranked.groupBy("user_id", "activity").agg(
        F.round(F.sum("duration_s"), 1).alias("total_s"),
        F.sum("observed_s").alias("observed_s"),
        F.count("*").alias("n_intervals"),
        F.min("start_s").alias("first_start"),
        F.array_sort(F.collect_list(span)).alias("_s"),
        F.min("start_s").alias("onset_s"),
        F.min_by("end_s", first).alias("onset_end"),
        F.min_by(own, first).alias("onset_measured"),
        F.nullif(F.sum((F.col("duration_s") >= prolonged_s).cast("long")), F.lit(0)).alias("n_long"),
    )
    return out.withColumn("spans", F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).withColumn("measured", F.transform("_s", lambda s: s["e"])).drop("_s")


def by_user(intervals: DataFrame, acts: DataFrame | None = None) -> DataFrame:
    """The leading activity (the first to occur of equals), the leading static one, and time at rest and in motion. `acts`: totals that are known already."""
    t = totals(intervals) if acts is None else acts
    order = F.struct("total_s", -F.col("first_start"))
    static = F.col("activity").isin(*STATIC)
    return t.groupBy("user_id").agg(
        F.max_by("activity", order).alias("leading"),
        F.max_by(F.when(static, F.col("activity")), F.when(static, order)).alias("leading_static"),
        F.coalesce(F.sum(F.when(static, F.col("total_s"))), F.lit(0.0)).alias("static_s"),
        F.coalesce(F.sum(F.when(F.col("activity").isin(*DYNAMIC), F.col("total_s"))), F.lit(0.0)).alias("dynamic_s"),
    )


def candidates(raw: DataFrame) -> DataFrame:
    """The longest interval of each activity before cleaning, the earlier of equals."""
    best = F.max_by(F.struct("start_s", "end_s", "duration_s"), F.struct("duration_s", -F.col("start_s")))
    return raw.groupBy("user_id", "activity").agg(best.alias("candidate"))


def resolve(questions: DataFrame, intervals: DataFrame, raw: DataFrame | None = None, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """questions (id, user_id, query, intent, activities, time_s) over cleaned intervals -> id, user_id, query, intent, answer,
    activity_event, spans, timestamps_text, modality, channels, explanation, facts (JSON).

    What can't be answered is N/A throughout. `raw` are the intervals before cleaning, from which a No cites the
    longest candidate that was too short. Where the intervals have `evidence` (see timeline.with_evidence), explanations and facts quote it."""
    raw = intervals if raw is None else raw
    acts = written(by_activity(intervals, config.prolonged_s), "activities")
    users = by_user(intervals, acts)
    q = questions.select("id", "user_id", "query", "intent", "activities", "time_s")
    q = q.withColumn("_q", F.lower("query")).withColumn("a1", F.get("activities", F.lit(0))).withColumn("a2", F.get("activities", F.lit(1)))
    q = q.withColumn("_prolonged", (F.col("intent") == "open_world") & has_any(F.col("_q"), PROLONGED_WORDS))
    q = q.withColumn("_wheeled", (F.col("intent") == "open_world") & ~F.col("_prolonged") & (has_any(F.col("_q"), WHEELED_WORDS) | F.coalesce(F.col("a1") == "Bicycling", F.lit(False))))
    hits = at_time(q.where("time_s is not null and intent in ('identification', 'verification')").select("id", "user_id", "time_s"), intervals)
    hits = hits.select("id", "user_id", F.col("activity").alias("hit"), F.col("start_s").alias("hit_start"), F.col("end_s").alias("hit_end"))
    if "evidence" in intervals.columns:
        own = intervals.select("user_id", F.col("activity").alias("hit"), F.col("start_s").alias("hit_start"), F.struct(*[F.col("evidence")[f].alias(f) for f in QUOTED]).alias("hit_measured"))
        hits = hits.join(own, ["user_id", "hit", "hit_start"], "left")
    else:
        hits = hits.withColumn("hit_measured", F.lit(None).cast(MEASURED))
    q = q.join(users, "user_id", "left").join(hits.drop("user_id"), "id", "left")
    main = F.when(F.col("_prolonged"), F.coalesce("a1", "leading_static")).when(F.col("_wheeled"), F.lit("Bicycling")).when((F.col("intent") == "identification") & F.col("time_s").isNull(), F.col("leading")).otherwise(F.col("a1"))
    q = q.withColumn("main", main)
    q = q.join(acts.withColumnRenamed("activity", "main"), ["user_id", "main"], "left")
    q = q.join(candidates(raw).withColumnRenamed("activity", "main"), ["user_id", "main"], "left")
    q = q.join(acts.select("user_id", F.col("activity").alias("a2"), F.col("total_s").alias("total_2")), ["user_id", "a2"], "left")
    return q.select("id", "user_id", "query", "intent", *answers(config))


def answers(c: TimelineConfig) -> list[Column]:
    col, lit = F.col, F.lit
    total, n, low = F.coalesce("total_s", lit(0.0)), F.coalesce("n_intervals", lit(0)), F.lower("main")
    total2 = F.coalesce("total_2", lit(0.0))
    at = col("time_s").isNotNull()
    kind = lambda k: col("intent") == k
    has = col("total_s").isNotNull()
    hit_span = F.array(F.struct(col("hit_start").alias("start"), col("hit_end").alias("end")))
    yes_at = F.coalesce(col("hit") == col("main"), lit(False))
    plain = kind("open_world") & ~col("_prolonged") & ~col("_wheeled")
    has_long = F.coalesce(col("n_long") > 0, lit(False))
    some = col("leading").isNotNull()
    blank = ~some | kind("unsupported") | (kind("identification") & at & col("hit").isNull()) | (kind("verification") & col("main").isNull()) | (kind("duration") & col("main").isNull()) | (kind("count") & col("main").isNull()) | (kind("grounding") & col("main").isNull()) | (kind("comparison") & (F.size("activities") < 2)) | (col("_prolonged") & col("main").isNull())
    yes = F.when(at, yes_at).otherwise(has)
    answer = (
        F.when(blank, NA)
        .when(kind("identification"), F.when(at, col("hit")).otherwise(col("leading")))
        .when(kind("verification"), F.when(yes, "Yes").otherwise("No"))
        .when(kind("duration"), F.concat(whole(total), lit(" seconds")))
        .when(kind("count"), n.cast("string"))
        .when(kind("comparison"), F.when(total >= total2, col("a1")).otherwise(col("a2")))
        .when(kind("grounding"), F.when(has, F.concat(lit("Yes, "), low, lit(" began at "), whole(col("onset_s")), lit(" seconds"))).otherwise("No"))
        .when(col("_prolonged"), F.when(has_long, "Yes").otherwise("No"))
        .when(col("_wheeled"), F.when(has, "Yes").otherwise("No"))
        .otherwise(F.when(col("static_s") >= col("dynamic_s"), "Mostly at rest").otherwise("Mostly physically active"))
    )
    event = (
        F.when(blank, NA)
        .when(kind("identification"), F.when(at, col("hit")).otherwise(col("leading")))
        .when(kind("comparison"), F.concat_ws(", ", "a1", "a2"))
        .when(kind("grounding") & has, F.concat(lit("Onset of "), low))
        .when(col("_prolonged"), F.concat(lit("Prolonged "), low))
        .when(col("_wheeled"), F.when(has, "Unknown outdoor physical activity, consistent with cycling").otherwise("No wheeled or pedal-based movement"))
        .when(plain, "Overall activity level")
        .otherwise(col("main"))
    )
    none = lit(None).cast(f"array<{SPAN}>")
    long_spans = F.slice("spans", lit(1), F.least(F.coalesce(col("n_long"), lit(0)), lit(3)).cast("int"))
    spans = (
        F.when(blank | plain | kind("comparison"), none)
        .when(kind("identification"), F.when(at, hit_span).otherwise(col("spans")))
        .when(kind("verification"), F.when(at & yes_at, hit_span).when(~at, col("spans")))
        .when(kind("grounding"), F.when(has, F.array(F.struct(col("onset_s").alias("start"), col("onset_end").alias("end")))))
        .when(col("_prolonged"), F.when(has_long, long_spans).otherwise(F.slice("spans", 1, 1)))
        .otherwise(col("spans"))
        .cast(f"array<{SPAN}>")
    )
    one = lambda e: F.array(e)
    measured = (
        F.when(kind("identification") & at | kind("verification") & at, one(col("hit_measured")))
        .when(kind("grounding"), one(col("onset_measured")))
        .otherwise(col("measured"))
        .cast(f"array<{MEASURED}>")
    )
    words = F.coalesce(evidence_text(F.get("measured", lit(0))), lit(""))
    with_words = F.when(words != "", F.concat(lit(", with "), words)).otherwise("")
    both = F.concat(col("a1"), lit(" = "), whole(total), lit(" seconds total, "), col("a2"), lit(" = "), whole(total2), lit(" seconds total"))
    text = F.when(~blank & kind("comparison"), both).otherwise(span_text(spans))
    length = lambda x: whole(x)
    cand = col("candidate")
    too_short = F.concat(lit(" ("), length(cand["start_s"]), lit(" to "), length(cand["end_s"]), lit(" s), too brief to indicate sustained "))
    first = F.get("spans", lit(0))
    first_s = first["end"] - first["start"]
    limit = whole(lit(c.prolonged_s))
    least = whole(lit(c.min_episode_s))
    explain = (
        F.when(blank, NA)
        .when(kind("verification") & ~yes & at, F.when(col("hit").isNotNull(), F.concat(lit("At "), whole(col("time_s")), lit(" s the detected activity is "), F.lower("hit"), lit(", not "), low, lit("."))).otherwise(F.concat(lit("No activity was detected at "), whole(col("time_s")), lit(" s."))))
        .when(kind("verification") & ~yes, F.when(cand.isNotNull(), F.concat(lit("No "), low, lit(" episode lasting at least "), least, lit(" s was detected. The longest candidate was "), length(cand["duration_s"]), lit(" s"), too_short, low, lit(" and consistent with a transient misclassification."))).otherwise(F.concat(lit("No "), low, lit(" was detected anywhere in the recording."))))
        .when(
            col("_prolonged"),
            F.when(
                has_long,
                F.concat(
                    lit("A continuous "), low, lit(" interval of "), length(first_s), lit(" s ("), length(first["start"]), lit(" to "), length(first["end"]), lit(" s) "), F.when(first_s <= c.prolonged_s, "reaches").otherwise("exceeds"),
                    lit(" the "), limit, lit(" s ("), whole(lit(c.prolonged_s / 60)), lit(" min) threshold for a prolonged period"), with_words, lit("."), F.when(col("n_long") > 1, F.concat(lit(" "), col("n_long").cast("string"), lit(" such intervals were found in total."))).otherwise(""),
                ),
            )
            .when(has, F.concat(lit("The longest continuous "), low, lit(" interval lasts "), length(first_s), lit(" s ("), length(first["start"]), lit(" to "), length(first["end"]), lit(" s), short of the "), limit, lit(" s ("), whole(lit(c.prolonged_s / 60)), lit(" min) needed to count as prolonged.")))
            .otherwise(F.concat(lit("No "), low, lit(" interval was detected in the recording."))),
        )
        .when(
            col("_wheeled"),
            F.when(has, F.concat(n.cast("string"), lit(" bicycling episode"), F.when(n > 1, "s").otherwise(""), lit(" totalling "), whole(total), lit(" s were detected; the longest runs "), length(first_s), lit(" s ("), length(first["start"]), lit(" to "), length(first["end"]), lit(" s)"), with_words, lit(", consistent with sustained pedal-driven movement.")))
            .when(cand.isNotNull(), F.concat(lit("No bicycling episode lasting at least "), least, lit(" s was detected. The longest candidate segment was "), length(cand["duration_s"]), lit(" s ("), length(cand["start_s"]), lit(" to "), length(cand["end_s"]), lit(" s), too brief to indicate sustained pedalling and consistent with a transient misclassification.")))
            .otherwise("No segment in the recording was classified as bicycling."),
        )
        .when(plain, F.concat(lit("Static activities (lying, sitting, standing in place) account for "), whole(col("static_s")), lit(" s against "), whole(col("dynamic_s")), lit(" s of movement.")))
        .otherwise(NA)
    )
    facts = F.when(~blank & kind("comparison"), F.to_json(F.map_from_arrays(F.array(F.concat(col("a1"), lit("_total_s")), F.concat(col("a2"), lit("_total_s"))), F.array(total, total2)))).when(~blank & ~plain & (has | kind("identification")) & ~(col("_prolonged") & ~has_long), F.to_json(F.struct(F.when(kind("duration") | kind("count") | (kind("verification") & yes), total).alias("total_s"), F.when(kind("duration") | kind("count"), n).alias("n_intervals"), F.when(kind("grounding"), col("onset_s")).alias("onset_s"), F.transform(spans, lambda s, i: F.struct(s["start"].alias("start_s"), s["end"].alias("end_s"), (s["end"] - s["start"]).alias("duration_s"), *[F.get(measured, i)[f].alias(f) for f in QUOTED if f != "step_freq_share"])).alias("intervals")))).otherwise("{}")
    known = F.when(blank, NA)
    return [answer.alias("answer"), event.alias("activity_event"), spans.alias("spans"), text.alias("timestamps_text"), known.otherwise(MODALITY).alias("modality"), known.otherwise(CHANNELS).alias("channels"), explain.alias("explanation"), facts.alias("facts")]


def answer_block() -> Column:
    """The seven lines of an answer."""
    return F.concat(F.lit("Answer: "), "answer", F.lit("\nActivity/Event: "), "activity_event", F.lit("\nEvidence:\n    Timestamp(s): "), "timestamps_text", F.lit("\n    Sensor Modality: "), "modality", F.lit("\n    Sensor Channel(s): "), "channels", F.lit("\nExplanation: "), F.coalesce("explanation", F.lit(NA)))


def answer(questions: DataFrame, intervals: DataFrame, config: TimelineConfig = TimelineConfig(), parser: Parser = parse, evidence: DataFrame | None = None) -> DataFrame:
    """questions (id, user_id, query) over uncleaned intervals: clean, parse, resolve and format. `evidence` (see signal_ops.timeline_evidence) of the uncleaned
    intervals follows them through cleaning and is quoted."""
    cleaned = clean_timeline(intervals, config.min_episode_s, config.max_gap_s)
    cleaned = written(cleaned if evidence is None else with_evidence(cleaned, evidence), "cleaned")
    return resolve(parser(questions), cleaned, intervals, config).withColumn("text", answer_block())
