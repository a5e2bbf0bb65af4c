"""Best-fit packing of documents into token sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so everything that has to be decided is decided on
the histogram of lengths (at most `capacity` rows, whatever the corpus): the driver plans on it,
Spark ranks the pieces of each length and looks up their places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written
from .wordbpe import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are ranked together, where that makes no more groups than the second number (and one for each length).
RANKED_TOGETHER, MOST_RANKED = 200, 50_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text, put end_id after it and cut what is longer than the capacity.

    Null texts are empty (their one piece holds end_id alone), null ids stay null, repeated rows
    give their pieces each time, an empty table gives none. With `with_ids` the ids come along.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(names, batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            for i in range(0, len(rows), 20_000):
                doc, piece, start, length, crc, part = zip(*rows[i : i + 20_000], strict=True)
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(part, pa.binary())] if with_ids else [])], [*keys, *(["ids"] if with_ids else [])])

    return text_rows(docs, id_col, text_col).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Fractional optimum of: fewest bins so that size k is packed demand[k] times. Column generation:
    the simplex method prices the sizes, a knapsack over the capacity finds the next configuration."""
    k = len(sizes)
    size = np.array(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    amount = np.array(demand, float) / basis.diagonal()
    for _ in range(20 * k + 100):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for g in np.flatnonzero(price > 0):
            for _ in range(capacity // sizes[g]):
                with_it = best[: -sizes[g]] + price[g]
                better = np.flatnonzero(with_it > best[sizes[g] :] + 1e-12)
                if not len(better):
                    break
                best[better + sizes[g]] = with_it[better]
                pick[better + sizes[g]] = g
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - step * ratio[out]
        amount[out] = ratio[out]
        basis[:, out] = column
    return [([int(x) for x in basis[:, j]], float(amount[j])) for j in range(k) if amount[j] > 1e-9]


def best_fit(left: dict[int, int], open_: Counter, capacity: int) -> Counter:
    """Put lengths (length -> number), the longest first, where they fit best; `open_` holds sequences (their lengths, longest
    first -> number), to which as few as possible are added."""
    room: dict[int, list[list]] = {}
    for items, n in open_.items():
        room.setdefault(capacity - sum(items), []).append([items, n])
    free = sorted(room)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            k = bisect_left(free, n)
            if k == len(free):
                fit, items, many = capacity, (), -(-count // (capacity // n))
            else:
                fit = free[k]
                items, many = room[fit].pop()
                if not room[fit]:
                    del room[fit], free[k]
            each = fit // n
            whole, rest = divmod(min(count, many * each), each)
            for used, some in ((each, whole), (rest, 1 if rest else 0), (0, many - whole - bool(rest))):
                if some:
                    now = fit - used * n
                    if now not in room:
                        room[now] = []
                        insort(free, now)
                    room[now].append([(*items, *(n,) * used), some])
            count -= min(count, many * each)
    out: Counter = Counter()
    for lists in room.values():
        for items, n in lists:
            out[tuple(sorted(items, reverse=True))] += n
    return out


def substituted(histogram: dict[int, int], capacity: int, groups: int) -> tuple[Counter, dict[int, int]]:
    """Sequences that the configurations of the groups open, with actual lengths in the places of the rounded ones, and what is left.

    A group's place takes the longest length there is that is no longer than the group's; the last place of a sequence takes the longest that still
    fits, so that the shorter actual lengths of the places before it leave no room."""
    left = dict(histogram)
    share = -(-sum(left.values()) // groups)
    demand: dict[int, int] = {}  # each group's longest length -> lengths that are rounded up to it
    filled, longest = share, 0
    for n in sorted(histogram, reverse=True):
        rest = left[n]
        while rest:
            if filled == share:
                longest, filled = n, 0
            part = min(rest, share - filled)
            demand[longest] = demand.get(longest, 0) + part
            filled += part
            rest -= part
    sizes = list(demand)
    free = sorted(left)
    made: Counter = Counter()
    for config, amount in sorted(configurations(sizes, list(demand.values()), capacity), reverse=True):
        places = [s for s, times in zip(sizes, config, strict=True) for _ in range(times)]
        parts: list[tuple[tuple[int, ...], int]] = [((), int(amount + 1e-6))]
        for i, size in enumerate(places):
            after = []
            for items, many in parts:
                most = capacity - sum(items) if i == len(places) - 1 else size
                while many and (k := bisect_right(free, most)):
                    n = free[k - 1]
                    now = min(many, left[n])
                    after.append(((*items, n), now))
                    left[n] -= now
                    many -= now
                    if not left[n]:
                        del free[k - 1]
                if many:
                    after.append((items, many))
            parts = after
        for items, many in parts:
            if items and many:
                made[tuple(sorted(items, reverse=True))] += many
    return made, left


def refitted(made: Counter, capacity: int, parts: int = 16) -> Counter:
    """Dissolve some of the sequences, a growing part of them up to half, and let best fit put their pieces back, as long as that saves any:
    those with room that hold the shortest pieces, the emptiest, or those of most pieces."""
    least = -(-sum(sum(items) * n for items, n in made.items()) // capacity)
    orders = (lambda x: (sum(x) == capacity, min(x), sum(x), x), lambda x: (sum(x), x), lambda x: (-len(x), sum(x), x))
    best = made
    for k in range(1, parts + 1):
        for order in orders:
            count = sum(best.values())
            if count <= least:
                return best
            keep, loose, taken = Counter(best), Counter(), 0
            for items in sorted(best, key=order):
                if taken >= count * k / parts / 2:
                    break
                n = keep.pop(items)
                taken += n
                for x in items:
                    loose[x] += n
            new = best_fit(loose, keep, capacity)
            if sum(new.values()) < count:
                best = new
    return best


def plan(histogram: dict[int, int], capacity: int, groups: int = 128, small: int = 8) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of pieces, pieces in each sequence, first sequence, offset there):
    piece t of a row goes to sequence first + t div each, at offset + (t mod each) * length.

    Lengths over capacity / `small` are large. They form groups of equal numbers, each rounded up to
    its longest; the configurations of the rounded lengths are optimised and opened as often as the
    whole part says; documents of the group take the places. What is left, and the small lengths,
    then go longest first where they fit best. What rounding lost is won back from the emptiest sequences, which are dissolved
    and fitted anew.
    """
    held = {n: c for n, c in histogram.items() if c > 0}
    large = {n: c for n, c in held.items() if capacity > n > capacity // small}
    made, left = substituted(large, capacity, groups) if large else (Counter(), {})
    if full := held.get(capacity):  # these fill a sequence by themselves
        made[(capacity,)] += full
    made = refitted(best_fit({**{n: c for n, c in held.items() if n <= capacity // small}, **left}, made, capacity), capacity)
    rows: list[tuple[int, int, int, int, int, int]] = []
    rank, opened = dict.fromkeys(held, 0), 0
    for items, count in made.items():
        at = 0
        for n, each in Counter(items).items():
            rows.append((n, rank[n], count * each, each, opened, at))
            rank[n] += count * each
            at += n * each
        opened += count
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 128) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...) that are read from a table.

    A piece's place depends on its rank among the pieces of its length. Ranks are counted within
    (length, salt) and shifted by what the salts before hold, so that a length that many
    documents share is not ranked in one task. Rows that are equal in id, piece and checksum are ranked arbitrarily.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(n is None or n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    together = max(RANKED_TOGETHER, -(-sum(counts.values()) // MOST_RANKED))
    salts = spark.createDataFrame([(n, -(-c // together)) for n, c in counts.items()], "length long, _salts long")
    placed = spark.createDataFrame(plan(counts, capacity, groups), "length long, _first long, _count long, _each long, _sequence long, _offset long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), "_salts"))
    held = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *(c for c in ("ids_crc32",) if c in pieces.columns))).cast("long") - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    at = F.col("_rank") - F.col("_first")
    found = ranked.join(F.broadcast(placed), "length").where((at >= 0) & (at < F.col("_count")))
    return found.select(*pieces.columns, (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity, groups)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed token sequences themselves: sequence_id, ids array<long> (at most `capacity` of them)."""
    packed = pack(written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids=True), "pieces"), capacity, groups)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [[x for p in sorted(parts, key=lambda p: p["offset"]) for x in np.frombuffer(p["ids"], "<u4").tolist()] for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts")).mapInArrow(unpack, "sequence_id long, ids array<long>")
