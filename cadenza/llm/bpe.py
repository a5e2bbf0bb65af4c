"""BPE encoding and decoding; long texts are encoded in halves that are joined as a tree.

A long text is halved again and again, wherever the middle falls, into leaves that are encoded in
parallel. At each join a window around it is encoded anew. It grows until both sides agree exactly: until it
has a token, with its id and its place, in common with the left side and another in common with the
right side. Where a run without white space spans the join, tokens are compared; at white space words
always end, so there both sides agree without a comparison.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordbpe import WordEncoder, by_words, encoder

#: Code points of a leaf, and of the shortest run without white space that is joined token by token.
LEAF, RUN = 16_384, 2_048
#: White space for which words end in the tokenizer, whatever stands beside it.
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Texts that hold a part of a special token's text are joined at white space only.
SPECIAL = "<|"

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, first and last + 1 code point of each token


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds the texts and ids of few rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text in halves of halves of no more than `leaf` code points; an empty text has one empty leaf."""
    parts = [text]
    while len(parts[0]) > leaf or any(len(p) > leaf for p in parts):
        parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
    return parts


def tokens_of(enc: WordEncoder, text: str, at: int = 0) -> Tokens:
    e = enc.tok.encode(text, add_special_tokens=False)
    off = np.array(e.offsets, np.int64).reshape(-1, 2) + at
    return np.array(e.ids, "<u4"), off[:, 0], off[:, 1]


def agree(a: Tokens, b: Tokens, first: bool) -> tuple[int, int] | None:
    """Index in a and in b of a common token, which is not at an end of either: the first or the last such."""
    keys = lambda t: {(int(i), int(s), int(e)): k for k, (i, s, e) in enumerate(zip(*t, strict=True)) if 0 < k < len(t[0]) - 1}
    there = keys(b)
    both = [(k, there[x]) for x, k in keys(a).items() if x in there]
    return (min if first else max)(both) if both else None


def joined_run(enc: WordEncoder, left: str, right: str, a: Tokens | None = None, b: Tokens | None = None, width: int = 256) -> Tokens:
    """Tokens of a run left + right without white space, from those of its halves (places count from each half's own start)."""
    if SPECIAL[0] in left or SPECIAL[0] in right:
        return tokens_of(enc, left + right)
    a = tokens_of(enc, left) if a is None else a
    b = tokens_of(enc, right) if b is None else b
    b = (b[0], b[1] + len(left), b[2] + len(left))
    text, cut = left + right, len(left)
    while True:
        lo, hi = max(0, cut - width), min(len(text), cut + width)
        # the window begins where a token of the left side does
        if lo:
            k = int(np.searchsorted(a[1], lo, side="right")) - 1
            lo = int(a[1][k]) if k > 0 else 0
        w = tokens_of(enc, text[lo:hi], lo)
        if lo == 0 and hi == len(text):
            return w
        head = (0, 0) if lo == 0 else agree(tuple(x[: max(0, len(a[0]) - 1)] for x in a), tuple(x[w[1] < cut] for x in w), True)
        keep = w[1] >= cut
        shift = int(np.argmax(keep)) if keep.any() else len(w[0])
        tail = (len(w[0]), 0) if hi == len(text) else agree(tuple(x[shift:] for x in w), b, False)
        if head is not None and tail is not None:
            i, j = head
            m, n = (len(w[0]), len(b[0])) if hi == len(text) else (tail[0] + shift, tail[1])
            if j <= m:
                return tuple(np.concatenate([x[:i], y[j:m], z[n:]]) for x, y, z in zip(a, w, b, strict=True))
        width *= 2


def run_tokens(enc: WordEncoder, run: str, leaf: int = RUN) -> Tokens:
    """Tokens of a run without white space, by halves where it is long."""
    if len(run) <= leaf or SPECIAL[0] in run:
        return tokens_of(enc, run)
    half = len(run) // 2
    return joined_run(enc, run[:half], run[half:], run_tokens(enc, run[:half], leaf), run_tokens(enc, run[half:], leaf))


class Part:
    """An encoded stretch of a text: ids of what lies between its first and last white space, and the two runs
    at its ends, still open, with their tokens where they are long. Without white space it is one open run."""

    __slots__ = ("head", "ids", "tail", "whole", "tokens_head", "tokens_tail")

    def __init__(self, enc: WordEncoder, text: str):
        found = SPACE.search(text)
        self.whole = found is None
        if self.whole:
            self.head, self.ids, self.tail = text, b"", ""
        else:
            last = len(text) - 1 - next(i for i, c in enumerate(reversed(text)) if SPACE.match(c))
            self.head, self.tail = text[: found.start()], text[last + 1 :]
            self.ids = enc.encode(text[found.start() : last + 1])
        long = lambda run: run_tokens(enc, run) if len(run) > RUN else None
        self.tokens_head, self.tokens_tail = long(self.head), long(self.tail)

    def join(self, enc: WordEncoder, other: Part) -> Part:
        """This stretch and the one after it as one. The run over the join is closed if both have white space."""
        left, lt = (self.head, self.tokens_head) if self.whole else (self.tail, self.tokens_tail)
        right, rt = other.head, other.tokens_head
        run = left + right
        run_t = joined_run(enc, left, right, lt, rt) if len(run) > RUN and left and right else rt if not left else lt if not right else None
        out = Part.__new__(Part)
        out.whole = self.whole and other.whole
        if self.whole:
            out.head, out.tokens_head, out.ids, out.tail, out.tokens_tail = run, run_t, other.ids, other.tail, other.tokens_tail
        elif other.whole:
            out.head, out.tokens_head, out.ids, out.tail, out.tokens_tail = self.head, self.tokens_head, self.ids, run, run_t
        else:
            out.head, out.tokens_head, out.tail, out.tokens_tail = self.head, self.tokens_head, other.tail, other.tokens_tail
            out.ids = self.ids + closed(enc, run, run_t) + other.ids
        return out

    def all_ids(self, enc: WordEncoder) -> bytes:
        ends = closed(enc, self.head, self.tokens_head), closed(enc, self.tail, self.tokens_tail)
        return ends[0] if self.whole else ends[0] + self.ids + ends[1]


def closed(enc: WordEncoder, run: str, tokens: Tokens | None) -> bytes:
    return enc.encode(run) if tokens is None else tokens[0].astype("<u4").tobytes()


def join_tree(enc: WordEncoder, parts: list[Part]) -> bytes:
    """Join neighbours, level by level."""
    while len(parts) > 1:
        parts = [parts[i].join(enc, parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].all_ids(enc)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit) of every row.

    Null texts are empty and have no ids; null ids stay; repeated rows are returned each time; an empty
    table gives an empty result; other columns are left out. Rows with texts of up to `leaf` code
    points are encoded where they are. Leaves of longer ones are dealt out to all tasks; not so with a tokenizer of other rules
    than those that make words independent, which encodes each text whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    if not by_words(tokenizer):
        return rows.mapInArrow(short, "doc_id long, ids binary")
    long = long_ids(rows.where(F.char_length("text") > leaf), tokenizer, leaf)
    return rows.where(F.char_length("text") <= leaf).mapInArrow(short, "doc_id long, ids binary").unionByName(long)


def long_ids(rows: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids of rows (doc_id, text), through leaves that are encoded apart and joined."""
    import pickle
    import uuid

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts, key = leaves(text, leaf), uuid.uuid4().hex
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["row", "doc_id", "leaf", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            made = [pickle.dumps({s: getattr(p, s) for s in Part.__slots__}) for p in (Part(enc, t) for t in b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.binary())], ["row", "doc_id", "leaf", "part"])

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        enc, parts = encoder(tokenizer), []
        for r in sorted(table.to_pylist(), key=lambda r: r["leaf"]):
            p = Part.__new__(Part)
            for s, v in pickle.loads(r["part"]).items():
                setattr(p, s, v)
            parts.append(p)
        return pa.table([pa.array([table.column("doc_id")[0].as_py()], pa.int64()), pa.array([join_tree(enc, parts)], pa.binary())], names=["doc_id", "ids"])

    # written once: the rows' random keys must not change when a task is repeated
    pieces = written(rows.mapInArrow(cut, "row string, doc_id long, leaf int, text string"), "leaves")
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = pieces.repartition(n, "row", "leaf").mapInArrow(encode, "row string, doc_id long, leaf int, part binary")
    return parts.groupBy("row").applyInArrow(join, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, ids), as the library decodes with special tokens kept."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(np.frombuffer(x, "<u4").tolist()).decode("utf-8") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows, without bringing the decoded texts back to Spark."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches):
            ids = b.column(1).to_pylist()
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(enc.decode(np.frombuffer(x, "<u4").tolist())) for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
