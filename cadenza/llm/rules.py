"""Quality rules: a learned decision list over statistics of texts, in DataFrame functions only.

Every text is measured once. From labelled documents sequential covering learns conjunctions of thresholds, one after another: a
rule grows by the condition of the highest gain, is pruned on documents that did not grow it, and what it covers is left
out before the next. All counts are aggregates over a bounded sample, a job for each condition. The list comes out as conditions in their order: a Spark
expression, and text that can be read or stored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows, written

#: White space that parts words, symbols that are counted, words of a window.
BLANKS, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5
#: The base rule: fewest words, and the share of words in repeated windows (in hundredths) that is not exceeded.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bound of the training sample, labelled documents of each label; of these, one in GROW_OF prunes and the others grow.
MOST_LABELLED, PRUNE_ONE_IN = 20_000, 3
#: Thresholds of a statistic that are tried for each label, conditions of a rule, rules of a list.
CUTS, MOST_CONDITIONS, MOST_RULES = 24, 4, 12
#: A rule stays if so large a share of what it covers is of low quality, where it grew and where it was pruned, and if it covers so many there.
LEAST_PRECISION, LEAST_COVERED = 0.9, 3


def window_hashes(hashes: Column) -> Column:
    """A hash of each window of words, from the hashes of the words."""
    some = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) >= WINDOW, some).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """How many words lie in windows that a text holds twice or more. Where hashes repeat at all, they are sorted with their places; those equal to
    a neighbour are repeated, and each covers what those before it left of its words."""

    def places(w: Column) -> Column:
        same = lambda x, k: F.get(w, k)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(w, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = F.transform(F.array(ordered), places)[0]  # an array of one, so that they are sorted once
    none = F.struct(F.lit(0).alias("next"), F.lit(0).cast("long").alias("n"))
    words = F.aggregate(found, none, lambda s, i: F.struct((i + WINDOW).alias("next"), (s["n"] + i + WINDOW - F.greatest(i, s["next"])).alias("n")), lambda s: s["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(words)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row's whole text; null texts have no words."""
    rows = text_rows(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", F.filter(F.split("text", f"[{BLANKS}]+"), lambda w: w != "").alias("_words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]")).alias("_lines"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_windows", window_hashes(F.col("_hashes")))
    of = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        of(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        of("[A-Z]").alias("n_upper"),
        of("[0-9]").alias("n_digits"),
        of("[.,;:]").alias("n_stops"),
        of("[!?]").alias("n_calls"),
    )


#: What rules put thresholds on: one count by another, 0 where that is 0.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_case": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"),
    "calls_per_word": ("n_calls", "n_words"),
}


def feature(name: str) -> Column:
    top, below = FEATURES[name]
    value = F.col(top).cast("double")
    return value if below is None else F.coalesce(F.try_divide(value, F.col(below).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.above else feature(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Low quality if all conditions hold; how many labelled documents it covered that earlier rules did not, and how many of these were of low quality."""

    conditions: tuple[Condition, ...]
    covered: int
    low: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in the order in which they are tried; what none covers is kept."""

    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The first rule that holds, as text; null where none does."""
        out = F.when(F.lit(False), F.lit(""))
        for r in self.rules:
            out = out.when(r.column(), F.lit(str(r)))
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"if {r} then drop" for r in self.rules), "keep"])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def training_sample(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """low (label 0), prune, and the features, of `most` documents of each label at most, those whose ids have the smallest hashes. Null labels are left out; a
    document labelled more than once has its smallest label. What the base rule drops is not learnt from, as no rule has to judge it."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.groupBy("doc_id").agg((F.min("label") == 0).alias("low"))
    rows = stats.where(~base_failed()).join(marked, "doc_id").select("low", F.xxhash64("doc_id").alias("_h"), "doc_id", *(feature(n).alias(n) for n in FEATURES))
    parts = [rows.where(F.col("low") == y).orderBy("_h", "doc_id", *FEATURES).limit(most) for y in (True, False)]
    prune = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(PRUNE_ONE_IN)) == 0
    return written(parts[0].unionAll(parts[1]).select("low", prune.alias("prune"), *FEATURES), "rule_sample")


def cuts_of(sample: DataFrame) -> list[list[float]]:
    """For each feature thresholds to try, in order: quantiles within each label."""
    at = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    rows = sample.groupBy("low").agg(*(F.percentile_approx(n, at, 10_000).alias(n) for n in FEATURES)).collect()  # two rows
    return [sorted({v for r in rows for v in r[n]}) for n in FEATURES]


class Counts:
    """Sampled documents, by feature, bin, whether they prune and whether they are of low quality, of those that a filter lets through."""

    def __init__(self, binned: DataFrame, where: Column):
        self.of: dict[tuple[int, bool], dict[int, list[int]]] = {}
        rows = binned.where(where).select("low", "prune", F.posexplode("bins").alias("feature", "bin")).groupBy("low", "prune", "feature", "bin").count()
        for r in rows.collect():  # features * bins * 4 at most
            self.of.setdefault((r["feature"], r["prune"]), {}).setdefault(r["bin"], [0, 0])[0 if r["low"] else 1] += r["count"]

    def within(self, k: int, prune: bool, above: bool | None = None, cut: int = 0) -> tuple[int, int]:
        """Low and other documents on one side of a cut of feature k, or all."""
        some = [c for b, c in self.of.get((k, prune), {}).items() if above is None or (b > cut) == above]
        return sum(c[0] for c in some), sum(c[1] for c in some)


def grown(counts: Counts, cuts: list[list[float]]) -> tuple[int, bool, int] | None:
    """The feature, side and cut of the highest gain: documents of low quality that stay, times what their share's logarithm gains. None where nothing gains."""
    p0, n0 = counts.within(0, False)
    best, found = 1e-9, None
    for k, of in enumerate(cuts):
        for cut in range(len(of)):
            for above in (True, False):
                p, n = counts.within(k, False, above, cut)
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if gain > best:
                    best, found = gain, (k, above, cut)
    return found


def reached(name: str, cuts: list[float]) -> Column:
    """How many of the cuts a feature exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(name))) if cuts else F.lit(0)


def widest(rows: DataFrame, name: str, above: bool, cut: float) -> Condition:
    """The condition with its threshold in the middle between the sampled values on either side of the cut, so that it covers the same of them."""
    v = F.col(name)
    low, high = rows.agg(F.max(F.when(v <= cut, v)), F.min(F.when(v > cut, v))).first()
    return Condition(name, above, cut if low is None or high is None else (low + high) / 2)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = MOST_LABELLED) -> DecisionList:
    """Sequential covering of documents of low quality (label 0) by rules over rows of `measured`. Without documents of both labels the list is empty."""
    sample = training_sample(stats, labels, id_col, label_col, most)
    cuts = cuts_of(sample)
    names = list(FEATURES)
    bins = F.array(*(reached(n, of) for n, of in zip(names, cuts, strict=True)))
    binned = written(sample.withColumn("bins", bins), "rule_bins")
    side = lambda c: F.col("bins")[c[0]] > c[2] if c[1] else F.col("bins")[c[0]] <= c[2]
    holds = lambda cs: reduce(lambda a, b: a & b, map(side, cs), F.lit(True))
    left, rules = F.lit(True), []
    while len(rules) < MOST_RULES:
        counts, conditions, best = Counts(binned, left), [], None
        if not counts.within(0, False)[0] or not counts.within(0, False)[1]:
            break
        while len(conditions) < MOST_CONDITIONS and (one := grown(counts, cuts)):
            conditions.append(one)
            (p, n), (u, v) = (counts.within(one[0], prune, one[1], one[2]) for prune in (False, True))
            worth = (u - v) / (u + v) if u + v else -1.0
            if best is None or worth > best[0]:  # the shortest of the best
                best = (worth, len(conditions), p, n, u, v)
            if not n:
                break
            counts = Counts(binned, left & holds(conditions))
        if best is None:
            break
        _, size, p, n, u, v = best
        if p < LEAST_COVERED or p < LEAST_PRECISION * (p + n) or not u or u < LEAST_PRECISION * (u + v):
            break
        own = conditions[:size]
        rules.append(Rule(tuple(widest(binned.where(left), names[k], above, cuts[k][cut]) for k, above, cut in own), p + n + u + v, p + u))
        left = left & ~holds(own)
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, kept, and rule (what dropped it beyond the base, else null) of every row.

    Null texts have no words and fail the base rule, null ids stay, repeated rows are returned each time, an empty table gives an empty result; other
    columns are left out. Windows are told apart by 64-bit hashes: of a text's 20,000 windows two that differ share one with a chance of 10^-11. A text's words
    and windows are arrays of one row, so a task has to hold those of its longest text.
    """
    stats = written(measured(docs, id_col, text_col), "text_statistics")
    rule = learn(stats, labels, id_col).column()
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rule))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
