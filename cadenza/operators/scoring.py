"""Scores of answers against true ones: both rule sets, strictness curves and error statistics.

scored rows: id, type, answer, spans, modality, channels (what was answered) and true_answer, true_spans, numeric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_number, interval_iou, normal_answer, yes_no
from .timeline import held_segments
from ..schema import CHANNELS, CLASSES, MODALITY


def best_iou(of: Column, among: Column) -> Column:
    """Mean over the spans `of` of the best overlap with any span of `among`."""
    best = F.transform(of, lambda p: F.array_max(F.transform(among, lambda r: interval_iou(p["start"], p["end"], r["start"], r["end"]))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(of)


def truth_iou(pred: Column, true: Column) -> Column:
    """Over true spans; both without spans: 1, only one: 0."""
    none = lambda s: F.coalesce(F.size(s), F.lit(0)) <= 0
    return F.when(none(pred) & none(true), F.lit(1.0)).when(none(pred) | none(true), F.lit(0.0)).otherwise(best_iou(true, pred))


def cited_iou(pred: Column, true: Column) -> Column:
    """Over cited spans; null without spans on either side."""
    some = lambda s: F.coalesce(F.size(s), F.lit(0)) > 0
    return F.when(some(pred) & some(true), best_iou(pred, true))


def score(rows: DataFrame, dur_tol: float = 0.10, cnt_tol: float = 1.0, iou_thr: float = 0.5) -> DataFrame:
    """The final rules: durations within dur_tol, counts within cnt_tol, yes and no in any wording, onsets with overlap and evidence."""
    p, t = first_number(F.col("answer")), F.col("numeric")
    err = F.abs(p - t)
    iou = cited_iou(F.col("spans"), F.col("true_spans"))
    mod = (F.col("modality") == MODALITY) & (F.col("channels") == CHANNELS)
    yn = yes_no(F.col("answer")) == yes_no(F.col("true_answer"))
    same = F.lower(F.trim("answer")) == F.lower("true_answer")
    kind = F.col("type")
    correct = (
        F.when(kind.isin("identification", "comparison"), same)
        .when(kind.isin("verification", "open_world"), yn)
        .when(kind == "duration", err <= dur_tol * t)
        .when(kind == "count", err <= cnt_tol)
        .when(kind == "grounding", F.when(F.col("true_answer") == "No", yn).otherwise(yn & F.coalesce(iou >= iou_thr, F.lit(False)) & mod))
    )
    refs = (F.coalesce(F.size("true_spans"), F.lit(0)) > 0) & (yes_no(F.col("true_answer")) != "no")
    correct = F.coalesce(correct, F.lit(False))
    counted = kind.isin("duration", "count")
    return rows.withColumns({"correct": correct, "abs_err": F.when(counted, err), "rel_err": F.when(kind == "duration", F.try_divide(err, F.nullif(t, F.lit(0.0)))), "iou": iou, "grounded": F.when(refs, correct & F.coalesce(iou >= iou_thr, F.lit(False)) & mod)})


def score_dev(rows: DataFrame, rel: float = 0.10, slack_s: float = 30.0, cnt_tol: float = 1.0, onset_s: float = 60.0, iou_thr: float = 0.5) -> DataFrame:
    """The development rules: durations within the larger of slack_s and rel, texts literally (case and final stops aside), onsets within onset_s."""
    p, t = first_number(F.col("answer")), F.coalesce("numeric", first_number(F.col("true_answer")))
    same = normal_answer(F.col("answer")) == normal_answer(F.col("true_answer"))
    iou = truth_iou(F.col("spans"), F.col("true_spans"))
    mod = (F.col("modality") == MODALITY) & (F.col("channels") == CHANNELS)
    near = F.coalesce(F.abs(p - t) <= onset_s, same)
    kind = F.col("type")
    correct = F.when(kind == "duration", F.abs(p - t) <= F.greatest(F.lit(slack_s), rel * t)).when(kind == "count", F.abs(p - t) <= cnt_tol).when(kind == "grounding", near & (iou >= iou_thr) & mod).otherwise(same)
    return rows.withColumns({"correct": F.coalesce(correct, F.lit(False)), "iou": iou})


def aggregate(scored: DataFrame) -> DataFrame:
    """Share correct by type, and with type null the macro and micro means."""
    per = scored.groupBy("type").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = per.agg(F.lit(None).cast("string").alias("type"), F.sum("n").alias("n"), F.avg("accuracy").alias("macro"), (F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("micro"))
    return per.withColumns({"macro": F.lit(None).cast("double"), "micro": F.lit(None).cast("double")}).unionByName(every.withColumn("accuracy", F.lit(None).cast("double")))


def errors(scored: DataFrame) -> DataFrame:
    return scored.where("abs_err is not null").groupBy("type").agg(F.count("*").alias("n"), F.avg("abs_err").alias("mae"), F.avg("rel_err").alias("mape"), F.percentile("abs_err", 0.5).alias("median_abs_err"))


def binary(scored: DataFrame) -> DataFrame:
    """Of verification questions: counts, precision, recall, F1 and specificity."""
    t, p = yes_no(F.col("true_answer")) == "yes", yes_no(F.col("answer")) == "yes"
    n = scored.where("type = 'verification'").agg(*[F.count_if(c).alias(k) for k, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.select("*", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), div(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def grounding_gap(scored: DataFrame) -> DataFrame:
    rows = scored.where("grounded is not null")
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("plain"), F.avg(F.col("grounded").cast("double")).alias("grounded"))


def grounding_precision(cited: DataFrame, segments: DataFrame) -> DataFrame:
    """cited (id, user_id, activity, start, end) over segments (user_id, t_start, t_end, y_true): the share of an answer's cited spans at least
    half of whose segments are truly of the activity. Spans without a segment don't count."""
    k = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("activity")) - 1
    inside = held_segments(cited.withColumnsRenamed({"start": "start_s", "end": "end_s"}), segments, 3_600.0).withColumnsRenamed({"start_s": "start", "end_s": "end"})
    span = inside.groupBy("id", "start", "end").agg((F.avg((F.col("y_true") == k).cast("double")) >= 0.5).alias("ok"))
    return span.groupBy("id").agg(F.avg(F.col("ok").cast("double")).alias("grounding_precision"))


def strictness(scored: DataFrame, kind: str, grid: list[float]) -> DataFrame:
    """Share of answers that stay correct as one tolerance moves. kind: duration (relative), count, grounding (IoU) or onset (IoU of all with spans)."""
    value, keep, rows = {
        "duration": (F.col("abs_err"), lambda v, g: v <= g * F.col("numeric"), scored.where("type = 'duration'")),
        "count": (F.col("abs_err"), lambda v, g: v <= g, scored.where("type = 'count'")),
        "grounding": (F.col("iou"), lambda v, g: v >= g, scored.where("type = 'grounding' and true_answer <> 'No'")),
        "cited": (F.col("iou"), lambda v, g: v >= g, scored.where("size(true_spans) > 0")),
    }[kind]
    levels = F.explode(F.array(*map(F.lit, grid)))
    return rows.withColumn("tolerance", levels).groupBy("tolerance").agg(F.avg(F.coalesce(keep(value, F.col("tolerance")), F.lit(False)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def seven_class(scored: DataFrame) -> DataFrame:
    """Identification as a seven-class problem: an answer that is no class counts as the class after the true one."""
    names = F.array(*[F.lit(c.lower()) for c in CLASSES])
    t = F.array_position(names, F.lower("true_answer")).cast("int") - 1
    p = F.array_position(names, F.lower(F.trim("answer"))).cast("int") - 1
    return scored.where("type = 'identification'").select(t.alias("y_true"), F.when(p >= 0, p).otherwise((t + 1) % len(CLASSES)).alias("y_pred"))


def parser_agreement(parsed: DataFrame) -> DataFrame:
    """parsed (type, intent): share of intents that are the true type, by type."""
    return parsed.groupBy("type").agg(F.avg((F.col("type") == F.col("intent")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def latency(timings: DataFrame) -> DataFrame:
    """timings (name, ms, watts): median and 90th percentile, and energy in joules of the median query at the mean power."""
    return timings.groupBy("name").agg(F.percentile("ms", 0.5).alias("median_ms"), F.percentile("ms", 0.9).alias("p90_ms"), (F.avg("watts") * F.percentile("ms", 0.5) / 1000).alias("joules"))
