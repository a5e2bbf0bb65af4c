"""SimHash near-duplicates by exact comparison of tiles.

Fingerprints within `radius` bits of each other have population counts within `radius` of each
other, in the whole word and, added up, over its four 16-bit quarters. Tiles hold fingerprints with the
same four counts; only pairs of tiles whose counts differ by `radius` or less in all are compared, with
exclusive-or and bit counts. A comparison returns a forest of links that connects
what it found, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

QUARTERS, TILE = 4, 2048


def simhash(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of the XXH64 of word shingles, repeats included; ASCII capitals folded. Texts
    of fewer words are one shingle; no words give zero."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    first, last = (stop - size)[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """doc_id, row (null without row_col), fingerprint (as a signed long) of every row; null texts are empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([simhash(t, width, seed) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64))], ["doc_id", "row", "fingerprint"])

    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, row long, fingerprint long")


def quarter_counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, packed in one number, 5 bits each."""
    code = np.zeros(len(prints), np.int64)
    for q in range(QUARTERS):
        code = code * 32 + np.bitwise_count((prints >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.int64)
    return code


def near_cells(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, of each opposite pair the one that is larger."""
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b), (node, smallest node reachable through them) for the other nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return [(int(nodes[i]), int(nodes[j])) for i, j in enumerate(low.tolist()) if i != j]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over the links between two tiles (which may be the same)."""
    a, b = [], []
    for i in range(0, len(left), 256):
        apart = np.bitwise_count(left[i : i + 256, None] ^ right[None, :])
        x, y = np.nonzero(apart <= radius)
        a.append(left[i : i + 256][x])
        b.append(right[y])
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    real = a != b
    return forest(a[real], b[real]) if real.any() else []


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect distinct fingerprints (column fingerprint) of `radius` or fewer differing bits."""
    diffs = near_cells(radius)

    def tiles(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, number = key[0].as_py(), 0
        for b in batches:
            values = b.column("fingerprint").to_numpy(zero_copy_only=False)
            for i in range(0, len(values), TILE):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([number], pa.int64()), pa.array([values[i : i + TILE].tobytes()], pa.binary())], ["cell", "tile", "data"])
                number += 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(quarter_counts(values.view(np.uint64))), b.column(0)], ["cell", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found += tile_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius)
            if found:
                n, m = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["a", "b"])

    cells = prints.select("fingerprint").mapInArrow(counted, "cell long, fingerprint long")
    # a cell's tiles are cut from a stream of its rows, so a full cell is never held at once
    made = written(cells.groupBy("cell").applyInArrow(tiles, "cell long, tile long, data binary"), "tiles")
    steps = [sum(x * 32 ** (QUARTERS - 1 - i) for i, x in enumerate(d)) for d in diffs]
    right = made.select(F.col("cell").alias("to"), F.col("tile").alias("tile_b"), F.col("data").alias("data_b"))
    left = made.select("*", F.explode(F.array(*map(F.lit, steps))).alias("step")).withColumn("to", F.col("cell") + F.col("step"))
    pairs = left.join(right, "to").where((F.col("step") != 0) | (F.col("tile") <= F.col("tile_b")))
    # pairs of tiles are bounded work each; dealing them out evenly keeps a full cell from one task
    return pairs.select("data", "data_b").repartition(pairs.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2, row_col: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of `radius`
    or fewer differing bits) for every row; with row_col, a column of longs that differ, also row and kept: whether it is the one
    row of its component that stays, the smallest row of the smallest id.

    Null and empty texts have fingerprint zero and are linked like any other; null ids are never the
    smallest unless their component has no other; repeated rows are returned each time; an empty
    table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col, width, seed, row_col), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    groups = connected_components(links(distinct, radius))
    named = distinct.join(groups, distinct["fingerprint"] == groups["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "component").select("fingerprint", "component", "component_id")
    out = rows.join(labels, "fingerprint", "left")
    shown = ["doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"]
    if not row_col:
        return out.select(*shown)
    out = written(out, "labelled")
    first = out.where("doc_id <=> component_id").groupBy("component").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    return out.join(first, "row", "left").select(*shown, "row", F.coalesce("kept", F.lit(False)).alias("kept"))
