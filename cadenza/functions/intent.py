"""What a question asks for, by ordered keyword rules, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLASSES, INTENT_RULES, INTENTS, OPEN_PHRASES, PROLONGED_WORDS, VERB_STEMS
from .scalar import json_in, seconds_in


def has_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def starts_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w)
    return out


def rule_intent(query: Column) -> Column:
    """The first of INTENT_RULES that fits."""
    s = F.lower(query)
    out = F
    for intent, begins, holds, must in INTENT_RULES:
        out = out.when((starts_any(s, begins) | has_any(s, holds)) & s.contains(must), intent)
    return out.otherwise("unsupported")


STEM_CLASS = dict(VERB_STEMS)


def recovered_activities(query: Column) -> Column:
    """Classes named in the text, in class order; without any, those of verb stems at a word's start, in the stems' order.

    No stem begins another, so one pass finds at each word's start the only one that can be there."""
    s = F.lower(query)
    named = F.filter(F.array(*map(F.lit, CLASSES)), lambda c: F.contains(s, F.lower(c)))
    met = F.regexp_extract_all(s, F.lit(rf"\b({'|'.join(STEM_CLASS)})"), F.lit(1))
    stems = F.array_intersect(F.array(*map(F.lit, STEM_CLASS)), met)  # in the order of the first
    classes = F.create_map(*[F.lit(x) for pair in VERB_STEMS for x in pair])
    return F.when(F.size(named) > 0, named).otherwise(F.array_distinct(F.transform(stems, lambda stem: classes[stem])))


REPLY = "intent string, activities array<string>, time_s string"


def parse(questions: DataFrame, reply: str | None = None) -> DataFrame:
    """Adds intent, activities and time_s to questions (query). `reply` names a column with the answer of an outside parser, JSON
    within any text; what it lacks or gets wrong comes from the rules."""
    q = F.col("query")
    given = F.from_json(json_in(F.coalesce(F.col(reply), F.lit(""))), REPLY) if reply else F.lit(None).cast(f"struct<{REPLY.replace(' array', ':array').replace(' string', ':string')}>")
    rows = questions.withColumn("_g", given)
    said = F.lower(F.trim(F.col("_g.intent")))
    first = F.when(said.isin(*INTENTS), said).otherwise(rule_intent(q))
    known = F.map_from_arrays(F.array(*[F.lit(c.lower()) for c in CLASSES]), F.array(*map(F.lit, CLASSES)))
    named = F.array_distinct(F.filter(F.transform(F.coalesce(F.col("_g.activities"), F.array().cast("array<string>")), lambda a: F.try_element_at(known, F.lower(F.trim(a)))), lambda c: c.isNotNull()))
    rows = rows.withColumn("activities", F.when(F.size(named) > 0, named).otherwise(recovered_activities(q)))
    rows = rows.withColumn("time_s", F.coalesce(F.col("_g.time_s").try_cast("double"), seconds_in(q)))
    s = F.lower(q)
    kind = F.when(has_any(s, PROLONGED_WORDS) | has_any(s, OPEN_PHRASES), F.lit("open_world")).otherwise(first)
    few = (kind == "comparison") & (F.size("activities") < 2)
    return rows.withColumn("intent", F.when(few & (F.size("activities") > 0), "duration").when(few, "unsupported").otherwise(kind)).drop("_g")


#: A parser adds the columns intent, activities and time_s to a DataFrame with query.
Parser = Callable[[DataFrame], DataFrame]
