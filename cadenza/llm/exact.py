"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each sender (a slice of the rows) sorts the distinct fingerprints of its rows and sends every owner of
a fingerprint range one Golomb-Rice coded message. Owners answer with a bitmap of the sender's
fingerprints that others hold too. Only rows so suspected are shuffled with their texts, for
verification byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, written

#: Rows for each owner of a range, and bits of a fingerprint.
OWNED, BITS = 2_000_000, 56
#: Senders and owners that there are at most: each pair of them exchanges a message, so past these numbers each takes more rows instead.
MOST_SENDERS, MOST_OWNERS = 20_000, 2_000


def golomb_encode(values: np.ndarray, bits: int) -> tuple[bytes, int]:
    """Sorted distinct values below 2**bits -> (code, Rice parameter): each gap's quotient in unary, then
    its remainder in `parameter` bits."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.floor(np.log2(max(1.0, float(2**bits) / max(1, len(values)) * 0.69)))))
    ones, rest = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    start = np.concatenate([[0], np.cumsum(ones + 1 + k)])
    out = np.zeros(int(start[-1]), np.uint8)
    stop = start[:-1] + ones  # the zero that ends the unary part
    run = np.repeat(start[:-1] - np.concatenate([[0], np.cumsum(ones)[:-1]]), ones) + np.arange(int(ones.sum()))
    out[run] = 1
    for b in range(k):
        out[stop + 1 + b] = (rest >> np.uint64(k - 1 - b)) & np.uint64(1)
    return np.packbits(out).tobytes(), k


def golomb_decode(code: bytes, k: int, count: int) -> np.ndarray:
    """The inverse. Where a unary part starts depends on the one before, so this walks from zero to
    zero, one step a value; the remainders are then read all at once."""
    flat = np.unpackbits(np.frombuffer(code, np.uint8))
    bits, at = flat.tobytes(), 0
    stop, ones = np.empty(count, np.int64), np.empty(count, np.int64)
    for i in range(count):
        z = bits.find(b"\0", at)
        stop[i], ones[i] = z, z - at
        at = z + 1 + k
    rest = np.zeros(count, np.uint64)
    for b in range(k):
        rest = (rest << np.uint64(1)) | flat[stop + 1 + b].astype(np.uint64)
    return np.cumsum((ones.astype(np.uint64) << np.uint64(k)) | rest, dtype=np.uint64)


def normalised(text):
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def suspects(rows: DataFrame, total: int) -> DataFrame:
    """rows (_sender int, _print long) -> distinct (_sender, _print) held by another row as well."""
    owners = min(MOST_OWNERS, max(8, -(-total // OWNED)))
    width = (1 << BITS) // owners + 1

    def messages(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, times = np.unique(table.column("_print").to_numpy().astype(np.uint64), return_counts=True)
        cuts = np.searchsorted(values, np.arange(0, owners + 1, dtype=np.uint64) * np.uint64(width))
        out = []
        for o in range(owners):
            part = values[cuts[o] : cuts[o + 1]]
            if len(part):
                code, k = golomb_encode(part - np.uint64(o * width), width.bit_length())
                out.append((key[0].as_py(), o, len(part), k, code, np.packbits(times[cuts[o] : cuts[o + 1]] > 1).tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["_sender", "_owner", "_count", "_k", "_code", "_twice"])

    def answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        held = [golomb_decode(m["_code"], m["_k"], m["_count"]) for m in sent]
        values, senders = np.unique(np.concatenate(held), return_counts=True)
        shared = values[senders > 1]
        bitmaps = [np.packbits(np.isin(h, shared, assume_unique=True) | np.unpackbits(np.frombuffer(m["_twice"], np.uint8))[: m["_count"]].astype(bool)).tobytes() for m, h in zip(sent, held, strict=True)]
        return pa.table([pa.array([m["_sender"] for m in sent], pa.int32()), pa.array([key[0].as_py()] * len(sent), pa.int32()), pa.array(bitmaps, pa.binary())], names=["_sender", "_owner", "_bitmap"])

    def marked(key: tuple[pa.Scalar, ...], mine: pa.Table, bitmaps: pa.Table) -> pa.Table:
        values = np.unique(mine.column("_print").to_numpy().astype(np.uint64))
        cuts = np.searchsorted(values, np.arange(0, owners + 1, dtype=np.uint64) * np.uint64(width))
        flag = np.zeros(len(values), bool)
        for m in bitmaps.to_pylist():
            lo, hi = cuts[m["_owner"]], cuts[m["_owner"] + 1]
            flag[lo:hi] = np.unpackbits(np.frombuffer(m["_bitmap"], np.uint8))[: hi - lo].astype(bool)
        found = values[flag].astype(np.int64)
        return pa.table([pa.array(np.full(len(found), key[0].as_py()), pa.int32()), pa.array(found, pa.int64())], names=["_sender", "_print"])

    sent = rows.groupBy("_sender").applyInArrow(messages, "_sender int, _owner int, _count long, _k int, _code binary, _twice binary")
    back = sent.groupBy("_owner").applyInArrow(answers, "_sender int, _owner int, _bitmap binary")
    return rows.groupBy("_sender").cogroup(back.groupBy("_sender")).applyInArrow(marked, "_sender int, _print long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_sender: int = 50_000, row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, and row with row_col.

    Texts are equal when they are after each run of white space became one space; null counts as
    empty. Of equal texts the smallest id stays; null ids never stay if another id is there. Rows that repeat the smallest id all stay,
    unless row_col, a column of longs that differ, tells rows apart: then the one of them with the smallest stays alone.
    An empty table gives an empty result.
    """
    texts = text_rows(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("_norm"))
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.sha2(normalised(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("text_sha256"))
    light = light.withColumn("_print", F.conv(F.substring("text_sha256", 1, BITS // 4), 16, 10).cast("long"))
    light = written(light, "prints")
    total = light.count()
    senders = max(8, -(-total // max(rows_a_sender, total // MOST_SENDERS)))
    # any deal of the rows will do, as long as it is fixed: the row's number was written with it
    dealt = light.withColumn("_sender", F.pmod(F.xxhash64("row"), F.lit(senders)).cast("int"))
    found = suspects(dealt.select("_sender", "_print"), total)
    wanted = dealt.join(found, ["_sender", "_print"], "left_semi").select(F.xxhash64("doc_id", "text_sha256").alias("_row")).distinct()
    # the suspects' texts meet as bytes; the aggregate combines copies before the shuffle
    seen = texts.withColumn("_sha", F.sha2("_norm", 256)).withColumn("_row", F.xxhash64("doc_id", "_sha")).join(wanted, "_row", "left_semi")
    same = seen.groupBy("_sha", "_norm").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_n"))
    same = same.groupBy("_sha").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count("*").alias("_texts"))
    same = same.where(F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts with one SHA-256"))).otherwise(F.lit(True))).select("_sha", "_keep", "_n")
    out = light.join(same, light["text_sha256"] == same["_sha"], "left")
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    out = out.select("doc_id", "row", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not row_col:
        return out.select(*names)
    again = light.groupBy(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id")).agg(F.min("row").alias("_first"), F.count("*").alias("_times")).where("_times > 1")
    out = out.join(again, (out["text_sha256"] == again["_sha"]) & out["doc_id"].eqNullSafe(again["_id"]), "left")
    return out.withColumn("kept", F.col("kept") & (F.col("row") == F.coalesce("_first", "row"))).select(*names, "row")
