"""Divergence of the sources of each language, by scans over sorted runs of terms.

Documents are cut into terms block by block; what a block has of a term in a source is one run, so no document is ever in two of
them and a frequent term leaves one row a block. Runs are dealt out by (lang, term) and sorted by (lang, term, source, block); a scan over them adds up
counts and document frequencies as they pass and lets the terms of enough documents through. A second scan, over the
kept terms in chunks that each begin with the table of sources, gives sums for pairs of sources and the best terms of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What stands between terms becomes a blank, A to Z become lower case; bytes beyond ASCII are parts of terms.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Documents that a kept term has at least, and terms that are reported of each source.
LEAST_DOCS, TOP = 10, 10
SCALE_STEPS = 3  # of a thousand each: 10 ** 9
#: Terms that a block holds before it is sent, bytes that are cut at once, runs of a chunk, and cells of a matrix of terms and sources.
ENTRIES, AT_ONCE, CHUNK, CELLS = 600_000, 1 << 20, 200_000, 1 << 20
ROWS = 20_000
RUN = "lang string, term string, source string, block long, docs long, n long"
PART = "lang string, source string, part string, item string, value long"


def term_slices(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about AT_ONCE bytes; no term is cut."""
    raw, at = text.encode("utf-8").translate(TERM_BYTES), 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= AT_ONCE else raw.find(b" ", at + AT_ONCE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) -> RUN: for each block, how often and in how many documents each source has each term."""
    task, block = TaskContext.get().partitionId(), 0
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms, counts = list(times), list(times.values())
            for at in range(0, len(terms), ROWS):
                some = terms[at : at + ROWS]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([source] * k, pa.string()), pa.array([task << 32 | block] * k, pa.int64()), pa.array([docs[t] for t in some], pa.int64()), pa.array(counts[at : at + k], pa.int64())],
                    ["lang", "term", "source", "block", "docs", "n"],
                )

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(times), set()
            for terms in term_slices(text):
                times.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(times) - before
            if size >= ENTRIES:
                yield from sent()
                held, size, block = {}, 0, block + 1
    yield from sent()


def changes(b: pa.RecordBatch | pa.Table, *names: str) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row differs."""
    out = np.ones(b.num_rows, bool)
    if b.num_rows > 1:
        out[1:] = False
        for name in names:
            c = b.column(name)
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def summed_runs(b: pa.RecordBatch | pa.Table) -> pa.Table:
    """Sorted rows of RUN -> one row for each (lang, term, source), docs and n added up."""
    starts = np.flatnonzero(changes(b, "lang", "term", "source"))
    add = lambda name: pa.array(np.add.reduceat(b.column(name).to_numpy(), starts))
    first = b.take(pa.array(starts))
    return pa.table({"lang": first.column("lang"), "term": first.column("term"), "source": first.column("source"), "docs": add("docs"), "n": add("n")})


def kept_runs(least: int):
    """The scan over sorted runs: those of terms in `least` documents or more, (lang, term, source, n, first run of its term). It holds a batch and the
    term that is still open, which has a row for each source."""

    def finished(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            new = changes(t, "lang", "term")
            starts = np.flatnonzero(new)
            docs = np.add.reduceat(t.column("docs").to_numpy(), starts)
            keep = np.repeat(docs >= least, np.diff(starts, append=t.num_rows))
            out = pa.table({"lang": t.column("lang"), "term": t.column("term"), "source": t.column("source"), "n": t.column("n"), "first": pa.array(new)}).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_term: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(["lang", "term", "source", "docs", "n"])
            t = summed_runs(t if open_term is None else pa.concat_tables([open_term, t]))
            last = int(np.flatnonzero(changes(t, "lang", "term"))[-1])
            yield from finished(t.slice(0, last))
            open_term = t.slice(last)
        if open_term is not None:
            yield from finished(open_term)

    return scan


def price(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * terms)), exact, by long division: nothing in it exceeds 1000 * (total + 2 * terms)."""
    below = total + 2 * terms
    whole, rest = np.divmod(count + 2, below)
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Chunk:
    """Kept terms of a chunk of one language, as they pass, over the sources of the language."""

    def __init__(self, lang: str, number: int, top: int):
        self.lang, self.number, self.top = lang, number, top
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.terms = 0
        self.held: list[pa.Table] = []
        self.begun, self.any = 0, False

    def add_sources(self, t: pa.Table) -> None:
        self.sources += t.column("source").to_pylist()
        self.totals += t.column("n").to_pylist()
        self.terms = t.column("terms")[0].as_py()

    def add_runs(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(t.select(["term", "source", "n"]))
        self.begun += int(changes(t, "term").sum())
        if self.begun > max(1, CELLS // len(self.sources)):
            yield from self.sent(open_term=True)

    def sent(self, open_term: bool) -> Iterator[pa.RecordBatch]:
        """PART rows of the terms held, but for the last where more of it may follow."""
        if not self.held:
            return
        t = pa.concat_tables(self.held)
        starts = np.flatnonzero(changes(t, "term"))
        stop = int(starts[-1]) if open_term else t.num_rows
        starts = starts[starts < stop]
        room = max(1, CELLS // len(self.sources))
        for k in range(0, len(starts), room):
            yield from self.matrix(t.slice(starts[k], (starts[k + room] if k + room < len(starts) else stop) - starts[k]))
        self.held, self.begun = ([t.slice(stop)], 1) if stop < t.num_rows else ([], 0)

    def matrix(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole terms: sums for pairs, source before item, and the best terms of each source."""
        new = changes(t, "term")
        names = t.column("term").filter(pa.array(new))
        place = {s: i for i, s in enumerate(self.sources)}
        count = np.zeros((len(names), len(self.sources)), np.int64)
        count[np.cumsum(new) - 1, [place[s] for s in t.column("source").to_pylist()]] = t.column("n").to_numpy()
        totals = np.array(self.totals, np.int64)
        p, q = price(count, totals, self.terms), price(count.sum(1), totals.sum(), self.terms)
        term, source = np.nonzero((count > 0) & (p > q[:, None]))
        value = apart(p[term, source], q[term])
        order = np.lexsort((term, -value, source))  # terms stand in the order of their bytes
        ranks = np.arange(len(order)) - np.searchsorted(source[order], source[order])
        best = order[ranks < self.top]
        yield self.rows("term", source[best], names.take(pa.array(term[best])).to_pylist(), value[best])
        for i in range(len(self.sources) - 1):
            yield self.pairs(i, apart(p[:, i, None], p[:, i + 1 :]).sum(0))
        self.any = True

    def pairs(self, i: int, value: np.ndarray) -> pa.RecordBatch:
        return self.rows("pair", np.full(len(value), i), self.sources[i + 1 :], value)

    def rows(self, part: str, source: np.ndarray, items: list[str], value: np.ndarray) -> pa.RecordBatch:
        k = len(items)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * k, pa.string()), pa.array([self.sources[i] for i in source], pa.string()), pa.array([part] * k, pa.string()), pa.array(items, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.sent(open_term=False)
        if not self.any and self.number == 0:  # a language without kept terms has pairs all the same
            for i in range(len(self.sources) - 1):
                yield self.pairs(i, np.zeros(len(self.sources) - 1 - i, np.int64))


def compared(top: int):
    """The scan over chunks, rows (lang, chunk, kind, term, source, n, terms) sorted so: kind 0 has the language's sources with their totals, 1 the runs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            starts = np.flatnonzero(changes(t, "lang", "chunk", "kind")) if t.num_rows else []
            for start, stop in zip(starts, [*starts[1:], t.num_rows], strict=True):
                part = t.slice(start, stop - start)
                lang, number, kind = (part.column(c)[0].as_py() for c in ("lang", "chunk", "kind"))
                if chunk is None or (chunk.lang, chunk.number) != (lang, number):
                    if chunk is not None:
                        yield from chunk.end()
                    chunk = Chunk(lang, number, top)
                if kind == 0:
                    chunk.add_sources(part)
                else:
                    yield from chunk.add_runs(part)
        if chunk is not None:
            yield from chunk.end()

    return scan


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language lies from each other one (part `pair`), and the `top` terms that it has more of
    than the language (part `term`).

    A row is a document, whatever its id, so repeated rows count each; null texts, languages and sources are empty ones. A
    language of one source has no pairs; one without terms in `least_docs` documents has pairs of value 0. Ties rank by the bytes of the item. An empty
    table gives an empty result; other columns are left out. Totals of a language have to stay below 9 * 10 ** 15 terms, which a long holds a thousand
    times. A task of the second scan holds the sources of a language once (the result has a row for each two of them).
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    runs = rows.mapInArrow(block_runs, RUN).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    kept = written(runs.mapInArrow(kept_runs(least_docs), "lang string, term string, source string, n long, first boolean"), "kept_terms")
    chunks = max(1, -(-kept.count() // CHUNK))
    groups = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), F.lit("").alias("term"), "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), "term", "source", "n", F.lit(0).cast("long").alias("terms"))
    lines = groups.unionByName(dealt).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "kind", "term", "source")
    parts = written(lines.mapInArrow(compared(top), PART), "divergence")
    half = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = half.unionAll(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best)
