"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its content. The ledger holds which blob was scanned under which
version of which rule, and what was found. A scan takes one row for each blob that the ledger lacks, finds these rows by a bitmap of bounded
size and scans them where they are, so no text is ever shuffled. Findings are joined back to every path (row) that has the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, text_rows, with_bit, written


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates, leftmost and without overlap; one is kept if its group `group` has
    `least` or more characters. `cue` is a pattern that any text with a match has."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    cue: str


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key from its header to its END line; where that is missing, through header fields and base64 lines to the last of these. Lines may be
#: quoted, or joined by white space or a written \n. Groups repeat possessively, which costs no stack however long the text is.
BREAK = r"""(?:\\[nrt]|[\s"'`,;>|*#\\]){1,20}+"""
TO_END = r"(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
FIELDS = rf"(?:{BREAK}(?:Proc-Type|DEK-Info):\s*+[^\s\\]++)*+"
LAST = rf"{BREAK}[A-Za-z0-9+/]++(?:={{1,2}}+|(?=[ \t]*+(?:[\r\n]|\\[nr]|\z)))"
LINES = rf"(?:(?:{BREAK}[A-Za-z0-9+/]{{16,}}+(?!=))++(?:{LAST})?+|{BREAK}[A-Za-z0-9+/]{{16,}}+={{1,2}}+)?+"
PEM = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{TO_END}|{FIELDS}{LINES})"
#: Base rules, in the order of their kinds, and after them the ones that the ledger's users add.
RULES = (
    Rule("assign", 1, ASSIGN, 2, 6, r"(?i)(?:passw|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", 2, PEM, 0, 1, r"PRIVATE KEY"),
)
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points. What lies between matches comes from split, what matches from
    regexp_extract_all; running lengths of both give the places."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("size"), F.transform(value, F.char_length).alias("length"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        stop = begin + F.coalesce(part["size"], F.lit(0))
        hit = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(part["length"] >= rule.least, F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"))

    def walked(p: Column) -> Column:
        """In blocks of about the square root of their number, since each step copies what its block has found."""
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda i: F.slice(p, i * size + 1, size))
        long = lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + x["gap"] + F.coalesce(x["size"], F.lit(0)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        begins = F.aggregate(blocks, none, lambda t, b: F.struct((t["at"] + long(b)).alias("at"), F.concat(t["all"], F.array(t["at"])).alias("all")), lambda t: t["all"])
        return F.flatten(F.zip_with(blocks, begins, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(FINDINGS).alias("found")), step, lambda t: t["found"])))

    found = F.transform(F.array(parts), walked)[0]  # an array of one, so that the parts are made once
    return F.when(text.rlike(rule.cue), found).otherwise(F.array().cast(FINDINGS))


LEDGER = "blob string, kind string, version int, spans " + FINDINGS


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob (SHA-256 of the text), row (stands for both), text."""
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("blob"), "text")
    return rows.select("doc_id", "blob", F.xxhash64("doc_id", "blob").alias("row"), "text")


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """paths (blob, row) -> blob, row (one that has it), todo: the rules, as bits, that the ledger lacks on it. Hashes alone are joined."""
    every = (1 << len(rules)) - 1
    blobs = paths.groupBy("blob").agg(F.min("row").alias("row"))
    if ledger is None:
        return blobs.withColumn("todo", F.lit(every))
    done = reduce(lambda c, ir: c.when((F.col("kind") == ir[1].kind) & (F.col("version") == ir[1].version), 1 << ir[0]), enumerate(rules), F.when(F.lit(False), 0))
    have = ledger.select("blob", done.alias("_bit")).where("_bit is not null").groupBy("blob").agg(F.bit_or("_bit").alias("_have"))
    left = blobs.join(have, "blob", "left").select("blob", "row", F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("_have", F.lit(0)))).alias("todo"))
    return left.where("todo <> 0")


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new rows (blob, kind, version, spans), one for each unseen blob and rule version, spans empty or not; the caller
    appends them to the table. Equal texts are one blob, however many rows hold them; one of these is scanned, once for all rules."""
    rows = addressed(docs, id_col, text_col)
    todo = written(unseen(rows.select("blob", "row"), ledger, rules), "unseen")
    # blobs that lack the same rules have a bitmap of their own: as many as there are such sets, most often one
    sets = sorted(r["todo"] for r in todo.groupBy("todo").count().collect())  # 2 ** rules at most
    bits, order = F.lit(0), {r: i for i, r in enumerate(RULES)}
    for k, some in enumerate(sets):
        rows = with_bit(rows, "row", bitmap(todo.where(F.col("todo") == some).select("row"), "row"), f"_in{k}")
        bits = bits.bitwiseOR(F.when(F.col(f"_in{k}"), F.lit(some)).otherwise(F.lit(0)))
    rows = rows.withColumn("_bits", bits).where("_bits <> 0")
    each = []
    for i, r in enumerate(rules):
        due = F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0
        each.append(F.struct(F.lit(1 << i).alias("bit"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(due, matches(F.col("text"), r, order.get(r, len(order) + i))).alias("spans")))
    scanned = rows.select("blob", "row", F.array(*each).alias("_r"))
    # a bitmap lets some rows too many through, and a row may be repeated: each blob is taken once, with what it lacked
    once = scanned.join(todo, ["blob", "row"]).dropDuplicates(["blob"])
    return once.select("blob", F.explode(F.filter("_r", lambda x: F.col("todo").bitwiseAND(x["bit"]) != 0)).alias("_r")).select("blob", "_r.kind", "_r.version", "_r.spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: for blobs with any finding under the given rule versions, in order of start, then kind."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    hits = ledger.where(current & (F.size("spans") > 0))
    return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan_history(increments: list[DataFrame], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Take up increments of rows one after another: (doc_id, blob, spans of every row; the ledger with what was new). Each increment
    reads the ledger as those before left it, so a blob that comes again, under whatever path, is not scanned again."""
    paths = None
    for docs in increments:
        new = written(update_ledger(docs, ledger, rules, id_col, text_col), "ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
        own = addressed(docs, id_col, text_col).select("doc_id", "blob")
        paths = own if paths is None else paths.unionByName(own)
    found = written(blob_findings(ledger, rules), "findings")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(FINDINGS)).alias("spans")), ledger


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans (array of start, rank, stop, kind; empty where nothing was found) for every row.

    Null texts are empty, null ids stay, repeated rows are returned each time, an empty table gives an
    empty result; other columns are left out. Spans count code points, the end is exclusive.
    """
    return scan_history([docs], ledger, rules, id_col, text_col)[0]


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return scanned.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = s["start"] > state["at"]
        first = (state["at"] == 0) & (state["out"] == "")
        kept = F.when(new, F.substring(text, state["at"] + 1, s["start"] - state["at"])).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(new | first, F.concat(state["out"], kept, F.lit(mark))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2_147_483_647))))
