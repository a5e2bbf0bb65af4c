"""Alignment of two tokenizers over the same bytes, by packed bitsets of token ends.

The ends of a text's tokens are bits at byte places, one bitset for each tokenizer. AND of both gives the cuts that they
share, OR the stretches that belong to one token of each (the links), and counts of bits below a place the token there. A task puts documents into blocks: the
block's pairs of ids once, with the number of its documents that hold each, and for each document places in that
list. Pairs are counted over the corpus from the blocks, and each block gets the counts of its own pairs back.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written

#: Links of a block, about: its documents are answered in one task.
BLOCK_LINKS = 2_000_000
#: Rows that are encoded at once, and the code points of theirs.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20
#: An id pair is a * PAIR + b.
PAIR = 1 << 32
#: Runs without a change between white space and other characters that go to the tokenizers library: pattern matching elsewhere may run out of stack.
LONG_RUN = re.compile(r"\s{50000}|\S{50000}")
#: fixed values: pattern of the byte-level pre-tokenizer
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others for those from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def decimals(size: int, ends: str) -> np.ndarray:
    """Row id * 2 + k: the id in decimal digits and the k-th of ends, zero bytes where it is shorter."""
    wide = len(str(size)) + 1
    return np.frombuffer(b"".join(f"{i}{e}".encode().ljust(wide, b"\0") for i in range(size) for e in ends), np.uint8).reshape(-1, wide)


class ByteTokens:
    """Byte-level pair encoding of space + text, with special tokens as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet, vocab, merges = byte_alphabet(), spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.pieces[i] = word.encode() if word in special else bytes(alphabet[c] for c in word)
        self.size = np.array([len(p) for p in self.pieces])
        # where merges rank as their results' ids do, the ids are ranks, and a library that takes ranks gives the same tokens sooner
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        plain = spec.get("normalizer") is None and spec["model"].get("dropout") is None and not spec["model"].get("ignore_merges") and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if plain and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)):
            import tiktoken

            self.fast = tiktoken.Encoding("aligned", pat_str=BYTE_PATTERN, mergeable_ranks={self.pieces[i]: i for w, i in vocab.items() if w not in special}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        text = " " + text
        if self.fast is None or LONG_RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int64)


class PieceTokens:
    """Pieces with byte fallback; the model adds the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.size = np.array([len(p) for p in self.pieces])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens, np.ndarray, np.ndarray]:
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    return a, b, decimals(len(a.pieces), ",|"), decimals(len(b.pieces), ",;")


class Bits:
    """A bitset in 64-bit words, with the number of bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits lie below each place."""
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """Links and groups of one text's tokens, ids a and b, of the given numbers of bytes, over the same `size` bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, size: int):
        self.a, self.b = a, b
        self.ends_a, self.ends_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
        self.bits_a, self.bits_b = Bits.of(self.ends_a, size), Bits.of(self.ends_b, size)
        self.shared = Bits(self.bits_a.words & self.bits_b.words)
        self.n_groups = int(self.shared.before[-1])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens in a and b of each link: what ends where either tokenizer cuts lies in one token of each."""
        ends = Bits(self.bits_a.words | self.bits_b.words).select()
        return self.bits_a.rank(ends), self.bits_b.rank(ends)

    def groups_sha256(self, text_a: np.ndarray, text_b: np.ndarray) -> str:
        """Of the groups written out. A group's tokens of a, then those of b: each token's place in the whole is its own number and that of the other's tokens before."""
        group_a, group_b = self.shared.rank(self.ends_a), self.shared.rank(self.ends_b)
        last_a, last_b = np.diff(group_a, append=self.n_groups) != 0, np.diff(group_b, append=self.n_groups) != 0
        upto_a = np.cumsum(np.bincount(group_a, minlength=self.n_groups))  # tokens of a in groups up to this
        upto_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=self.n_groups))])
        out = np.zeros((len(self.a) + len(self.b), max(text_a.shape[1], text_b.shape[1])), np.uint8)
        out[np.arange(len(self.a)) + upto_b[group_a], : text_a.shape[1]] = text_a[self.a * 2 + last_a]
        out[np.arange(len(self.b)) + upto_a[group_b], : text_b.shape[1]] = text_b[self.b * 2 + last_b]
        return hashlib.sha256(out.tobytes().translate(None, b"\0")[:-1]).hexdigest()


#: Of a block: its number, its id pairs with the documents that hold each, and its documents, in arrays side by side; `places` and `times` are
#: little-endian 32-bit numbers: for each document in turn, `pairs` places in the block's list of pairs and how many links each has.
BLOCK = "block long, pair array<long>, docs array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, pairs array<int>, groups_sha256 array<string>, places binary, times binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Block:
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, doc: int | None, one: Aligned | None, text_a: np.ndarray, text_b: np.ndarray) -> None:
        if one is None:
            self.rows.append((doc, 0, 0, 0, 0, 0, ""))
            return
        at_a, at_b = one.links()
        pair, times = np.unique(one.a[at_a] * PAIR + one.b[at_b], return_counts=True)
        self.pairs.append(pair)
        self.times.append(times)
        self.links += len(at_a)
        self.rows.append((doc, len(one.a), len(one.b), one.n_groups, len(at_a), len(pair), one.groups_sha256(text_a, text_b)))

    def batch(self, number: int) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        pair, places, docs = np.unique(np.concatenate([none, *self.pairs]), return_inverse=True, return_counts=True)
        cols = list(zip(*self.rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        arrays = [pa.array([number], pa.int64()), one(pair, pa.int64()), one(docs.astype(np.int32), pa.int32()), *(one(list(c), k) for c, k in zip(cols, kinds, strict=True))]
        packed = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (places, np.concatenate([none, *self.times]))]
        return pa.RecordBatch.from_arrays([*arrays, *packed], [c.split()[0] for c in BLOCK.split(", ")])


def align_text(text: str, a: np.ndarray, b: np.ndarray, of_a: ByteTokens, of_b: PieceTokens) -> Aligned | None:
    """None where the tokens' bytes aren't those of space + text."""
    raw = b" " + text.encode("utf-8")
    if b"".join(map(of_a.pieces.__getitem__, a.tolist())) != raw or b"".join(map(of_b.pieces.__getitem__, b.tolist())) != raw:
        return None
    return Aligned(a, b, of_a.size[a], of_b.size[b], len(raw))


def blocks_of(path_a: str, path_b: str, most: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_a, of_b, text_a, text_b = tokenizers_of(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, Block()
        for b in batches:
            docs, texts, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while at < len(docs):
                stop, chars = at + 1, len(texts[at])
                while stop < len(docs) and stop - at < SLICE_ROWS and chars + len(texts[stop]) <= SLICE_CHARS:
                    chars += len(texts[stop])
                    stop += 1
                for doc, text, ids in zip(docs[at:stop], texts[at:stop], of_b.encode(texts[at:stop]), strict=True):
                    block.add(doc, align_text(text, of_a.encode(text), ids, of_a, of_b) if text else None, text_a, text_b)
                    if block.links >= most:
                        yield block.batch(number)
                        number, block = number + 1, Block()
                at = stop
        if block.rows:
            yield block.batch(number)

    return make


def answered(key: tuple[pa.Scalar, ...], block: pa.Table, answers: pa.Table) -> pa.Table:
    """Each document of a block: its links' counts added up, and the links whose count is the best of their first id."""
    own = block.to_pylist()[0]
    asked = np.array(own["pair"], np.int64)
    given = answers.column("pair").to_numpy()
    order = np.argsort(given)
    if not np.array_equal(given[order], asked):
        raise ValueError("a block did not get the counts of its pairs")
    count, best = answers.column("n").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
    places, times = (np.frombuffer(own[c], "<u4").astype(np.int64) for c in ("places", "times"))
    bounds = np.concatenate([[0], np.cumsum(own["pairs"])])
    added = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])
    sums = {"n_best": added(times * best[places]), "count_sum": added(times * count[places])}
    columns = {"doc_id": own["doc_id"], "n_a": own["n_a"], "n_b": own["n_b"], "n_groups": own["n_groups"], "n_links": own["n_links"]} | sums | {"groups_sha256": own["groups_sha256"]}
    return pa.table({k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in columns.items()})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of the same first id has more) over all blocks."""
    counts = blocks.select(F.explode(F.arrays_zip("pair", "docs")).alias("_p")).groupBy(F.col("_p.pair").alias("pair")).agg(F.sum("_p.docs").alias("n"))
    # the pairs of one first id are as many as the second vocabulary has ids at most
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("n") == most)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    path_a is a byte-level tokenizer (space + text), path_b a piece model (text). Null and empty texts, and texts that either tokenizer
    changes, have no tokens: zeros and an empty digest. Null ids stay; repeated rows are returned each time and count as documents of their own; an empty
    table gives an empty result; other columns are left out. A text is encoded by one task, and is a block of its own if it is long.
    """
    blocks = written(text_rows(docs, id_col, text_col).mapInArrow(blocks_of(path_a, path_b, block_links), BLOCK), "blocks")
    counts = written(pair_counts(blocks.select("pair", "docs")), "pair_counts")
    asked = blocks.select("block", F.explode("pair").alias("pair"))
    answers = asked.join(counts, "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(answered, OUT)
