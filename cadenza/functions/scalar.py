"""Scalar functions, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NA


def magnitude(*xyz: Column) -> Column:
    return F.sqrt(sum((x * x for x in xyz[1:]), xyz[0] * xyz[0]))


def to_g(x: Column, unit: float) -> Column:
    return F.bround(x / unit, 6)


def hour_features(epoch: Column, zone: str = "America/Los_Angeles") -> tuple[Column, Column, Column]:
    """Hour of day with its minutes as a fraction (seconds don't count), and its sine and cosine over 24 hours. The session's zone must be UTC."""
    local = F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)
    h = F.hour(local) + F.minute(local) / 60.0
    return h, F.sin(h * (2 * math.pi / 24)), F.cos(h * (2 * math.pi / 24))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull of both; 0 for an empty hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(hull > 0, both / hull).otherwise(F.lit(0.0))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def seconds_in(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*second", 1).try_cast("double")


def normal_answer(text: Column) -> Column:
    return F.rtrim(F.lower(F.trim(text)), F.lit("."))


def yes_no(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.startswith("yes") | s.startswith("likely yes"), "yes").when(s.startswith("no"), "no").otherwise(F.rtrim(s, F.lit(".")))


def whole(x: Column) -> Column:
    """A number without decimals, as text; halves go to the even neighbour."""
    return F.bround(x, 0).cast("long").cast("string")


def span_text(spans: Column) -> Column:
    """'a to b, c to d (seconds from start)' of an array of structs start, end; N/A without any."""
    each = F.transform(spans, lambda s: F.concat(whole(s["start"]), F.lit(" to "), whole(s["end"])))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.concat(F.array_join(each, ", "), F.lit(" (seconds from start)"))).otherwise(F.lit(NA))


def evidence_text(e: Column) -> Column:
    """What was measured in an interval, in words; empty without measurements."""
    bits = F.filter(
        F.array(
            F.when(e["acc_mag_mean"].isNotNull() & e["acc_mag_std"].isNotNull(), F.format_string("acceleration magnitude %.3f ± %.3f g", e["acc_mag_mean"], e["acc_mag_std"])),
            F.when(e["gyro_mag_mean"].isNotNull(), F.format_string("gyroscope activity %.3f rad/s", e["gyro_mag_mean"])),
            F.when(e["step_freq_share"] >= 0.15, F.format_string("a periodic component at %.2f Hz", e["step_freq_hz"])),
        ),
        lambda x: x.isNotNull(),
    )
    n = F.size(bits)
    return F.when(n > 1, F.concat(F.array_join(F.slice(bits, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(bits, -1))).when(n == 1, bits[0]).otherwise(F.lit(""))


def json_in(text: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)
