"""I-Match document fingerprints, in DataFrame functions only.

A text keeps its terms whose document frequency lies in a band (so their inverse document frequency
does); the distinct ones are sorted and hashed under several lexicons, each a random subset of
the band. The band is a table that the terms of the texts are joined with, whatever its size. Its lower end is a share of the documents, so it holds
no more than (mean number of distinct terms) / (that share) terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written

#: Shares of the documents that hold a term of the band: its inverse document frequency is between the negative logarithms.
RAREST, COMMONEST = 0.001, 0.2
#: (which hash of the term, first bit there, number of bits, kept if they are all zero or if they are not): one random subset of the
#: lexicon each, of 3/4, 1/8, 1/256 and 1/64 of its terms. Those of few terms outlast edits, and there are enough of them for short texts.
DENSE = tuple([(0, 2 * i, 2, False) for i in range(2)] + [(0, 4 + 3 * i, 3, True) for i in range(2)])
#: One for each byte of the hashes 1 to 3, and for the upper six bits of each byte of the hash 4.
SPARSE = tuple([(1 + i // 8, 8 * (i % 8), 8, True) for i in range(24)] + [(4, 8 * i + 2, 6, True) for i in range(8)])
SUBSETS = DENSE + SPARSE
#: Terms of a band that is broadcast (8 bytes each); a larger one is shuffled.
MOST_BROADCAST = 1_000_000
#: Rows whose successor is looked up together, and about how many such groups there are at most: beyond that they take more rows, which are
#: sorted with spilling.
NEIGHBOURS, MOST_GROUPS = 1_000, 4_096


def terms(text: Column) -> Column:
    """Hashes of the distinct words, ASCII capitals folded."""
    words = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(F.array_distinct(words), lambda w: w != ""), lambda w: F.xxhash64(w))


def base_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return text_rows(docs, id_col, text_col).select(terms(F.col("text")).alias("terms"))


def lexicon(term_lists: DataFrame, total: int, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """(term): hashes of the terms in the band. term_lists has a column terms, each list without repeats. The least document
    frequency is `rarest` of the documents, 4 at least."""
    low, high = max(4.0, rarest * total), max(4.0, commonest * total)
    df = term_lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return written(df.where((F.col("df") >= low) & (F.col("df") <= high)).select("term"), "lexicon")


def hash_of(t: Column, k: int) -> Column:
    return F.xxhash64(t, F.lit(k).cast("long")) if k else t


def zero_byte(x: Column) -> Column:
    """Whether one of the eight bytes of a long is zero."""
    half = lambda v: (v - F.lit(0x01010101)).bitwiseAND(F.bitwise_not(v)).bitwiseAND(F.lit(0x80808080).cast("long")) != 0
    return half(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) | half(F.shiftrightunsigned(x, 32))


def prints(kept: Column, all_terms: Column) -> Column:
    """One hash of the sorted terms for each subset (0: none of them occur), and one more for a text without any of the band: that of all its terms."""

    def hashed(terms_: Column, k: int, first: int, bits: int, zero: bool) -> Column:
        part = lambda t: F.shiftright(hash_of(t, k), first).bitwiseAND(F.lit((1 << bits) - 1))
        some = F.filter(terms_, lambda t: part(t) == 0 if zero else part(t) != 0)
        return F.transform(F.array(some), lambda e: F.when(F.size(e) > 0, F.xxhash64(e)).otherwise(F.lit(0)))[0]

    # most terms are in no sparse subset: these are looked for among the few that are in any
    upper = F.lit(int.from_bytes(b"\xfc" * 8, "big", signed=True))
    any_ = lambda t: zero_byte(hash_of(t, 1)) | zero_byte(hash_of(t, 2)) | zero_byte(hash_of(t, 3)) | zero_byte(hash_of(t, 4).bitwiseAND(upper))
    own = F.when(F.size(kept) == 0, all_terms).otherwise(F.lit(0))
    few = lambda k: F.transform(F.array(F.filter(k, any_)), lambda f: F.array(*[hashed(f, *s) for s in SPARSE]))[0]
    return F.transform(F.array(F.array_sort(kept)), lambda k: F.concat(F.array(*[hashed(k, *s) for s in DENSE]), few(k), F.array(own)))[0]


def with_prints(rows: DataFrame, band: DataFrame, keep: list[str], by: list[str], **texts: Column) -> DataFrame:
    """The columns `by` and `keep` of rows with a fingerprint (array<long>) of each of the texts. Rows that are dealt out by `by` already stay where they are.

    Each row's terms become rows that are joined with the band and meet again by a number given to the row; what else the row holds goes along once,
    with a first row that has no term."""
    names = list(texts)
    listed = rows.select(F.monotonically_increasing_id().alias("_row"), *by, F.struct(*keep).alias("_p"), *[terms(texts[n]).alias(f"_t{i}") for i, n in enumerate(names)])
    lists = [F.col(f"_t{i}") for i in range(len(names))]
    listed = listed.withColumns({f"_all{i}": F.xxhash64(F.array_sort(t)) for i, t in enumerate(lists)})
    each = listed.select("_row", *by, F.struct("_p", *[f"_all{i}" for i in range(len(names))]).alias("_p"), *[F.size(t).alias(f"_n{i}") for i, t in enumerate(lists)], F.posexplode(F.concat(F.array(F.lit(None).cast("long")), *lists)).alias("_pos", "term"))
    known = band.withColumn("_known", F.lit(True))
    each = each.join(F.broadcast(known) if band.count() <= MOST_BROADCAST else known, "term", "left").where("_pos = 0 or _known")
    ends, at = [], F.lit(0)
    for i in range(len(names)):
        at = at + F.col(f"_n{i}")
        ends.append(at)
    side = F.when(F.col("_pos") == 0, F.lit(None).cast("int"))
    for i, end in enumerate(ends):
        side = side.when(F.col("_pos") <= end, i)
    each = each.select("_row", *by, F.when(F.col("_pos") == 0, F.col("_p")).alias("_p"), side.alias("_side"), "term")
    met = each.groupBy(*by, "_row").agg(F.first("_p", ignorenulls=True).alias("_p"), *[F.collect_list(F.when(F.col("_side") == i, F.col("term"))).alias(f"_k{i}") for i in range(len(names))])
    return met.select(*by, "_p._p.*", *[prints(F.col(f"_k{i}"), F.col(f"_p._all{i}")).alias(n) for i, n in enumerate(names)])


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with equal hashes among those where either text has terms; 0 where only one text has terms of the band."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(both, lambda x: (x["a"] != 0) | (x["b"] != 0)))
    same = F.size(F.filter(both, lambda x: (x["a"] != 0) & (x["a"] == x["b"])))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def text_print(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def place(id_: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are no larger than the id; -1 for null. Looked up in a list of blocks, then in one block."""
    if not cuts:
        return F.when(id_.isNull(), F.lit(-1)).otherwise(F.lit(0))
    width = int(len(cuts) ** 0.5) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= id_))
    block = below(F.array(*[F.lit(b[0]).cast("long") for b in blocks]))
    inside = below(F.element_at(F.array(*[F.array(*[F.lit(c).cast("long") for c in b]) for b in blocks]), F.greatest(block, F.lit(1))))
    return F.when(id_.isNull(), F.lit(-1)).when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside)


def groups(rows: DataFrame, total: int) -> DataFrame:
    """rows (doc_id, _tie, ...) with _group (a struct that rises with doc_id, nulls first, and _tie): stretches of that order with about
    NEIGHBOURS rows each. An id that many rows share, or null, is cut by _tie."""
    size = max(NEIGHBOURS, total // MOST_GROUPS)
    n = max(1, total // size)
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    often = rows.groupBy("doc_id").count().where(F.col("count") > size).collect()  # total / size rows at most
    edges = {c for c in cuts or [] if c is not None} | {x for r in often if r["doc_id"] is not None for x in (r["doc_id"], r["doc_id"] + 1) if x < 2**63}
    parts = rows.sparkSession.createDataFrame([(r["doc_id"], -(-r["count"] // size)) for r in often], "_id long, _parts long")
    high = F.shiftright("_tie", 32) + F.lit(1 << 31)  # 0 to 2**32 in the order of _tie
    cut = rows.join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    part = F.shiftright(high * F.coalesce("_parts", F.lit(1)), 32).cast("int")
    return cut.withColumn("_group", F.struct(place(F.col("doc_id"), sorted(edges)).alias("i"), part.alias("j"))).drop("_id", "_parts")


def neighbours(rows: DataFrame, total: int) -> DataFrame:
    """rows (doc_id, _tie, ...) with _group and _guest, and the first row of each group once more as a guest (_guest = 1) at the end of the group
    before, that of the first at the end of the last: so every row but the guests has its successor after it in its group."""
    held = groups(rows, total).withColumn("_guest", F.lit(0))
    starts = held.groupBy("_group").agg(F.min(F.struct("doc_id", "_tie")).alias("s")).collect()  # about 2 * MOST_GROUPS rows at most
    starts.sort(key=lambda r: (r["_group"]["i"], r["_group"]["j"]))
    hosts = [(r["s"]["doc_id"], r["s"]["_tie"], tuple(starts[k - 1]["_group"])) for k, r in enumerate(starts)]
    hosts = rows.sparkSession.createDataFrame(hosts, "_id long, _at long, _host struct<i:int,j:int>")
    guests = held.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_at")))
    return held.unionByName(guests.withColumn("_group", F.col("_host")).withColumn("_guest", F.lit(1)).drop("_id", "_at", "_host"))


def following() -> Window:
    return Window.partitionBy("_group").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_tie")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """doc_id, text, print (array<long>) of every row.

    Null texts are empty, null ids stay, repeated rows are returned each time. A text without terms of
    the band is told by the hash of all its terms. An empty table gives no rows.
    """
    rows = text_rows(docs, id_col, text_col)
    return with_prints(rows, lexicon(base_terms(docs, id_col, text_col), rows.count(), rarest, commonest), ["doc_id", "text"], [], print=F.col("text"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Each text's fingerprint against that of its edited text (its last half replaced by as much of the next
    document's start) and of the next document. Rows are in the order of their ids, nulls first, then of a hash of their texts;
    the rest as in `fingerprint`."""
    rows = text_rows(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    total = rows.count()
    band = lexicon(base_terms(docs, id_col, text_col), total, rarest, commonest)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = neighbours(rows, total).withColumn("_next", F.lead("text").over(following()))
    edited = F.when(F.col("_guest") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))).otherwise(F.lit(""))
    both = both.withColumns({"n_chars": n.cast("long"), "_edited": edited}).withColumn("edited_sha256", F.sha2("_edited", 256))
    out = with_prints(both, band, ["doc_id", "_tie", "_guest", "n_chars", "edited_sha256"], ["_group"], print=F.col("text"), edited_print=F.col("_edited"))
    out = out.withColumn("_next", F.lead("print").over(following())).where("_guest = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", text_print(F.col("print")).alias("fingerprint"), text_print(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("_next")).alias("near_next"))
