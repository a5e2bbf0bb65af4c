import random
import zlib

import numpy as np
import pytest

from cadenza.llm import bpe, packing
from cadenza.llm.wordbpe import WordEncoder


@pytest.fixture(scope="module")
def enc(tokenizer):
    return WordEncoder(tokenizer)


def library(enc, text):
    return np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PIECES = ["a", "B", "c'", "s", "'re", "T", "1", "é", "́", "İ", "ǅ", "\x1c", "\x85", " ", "\x0b", "\n", "!", "<|", "|>", ".", ",;", "K", "Σ", "中", "😀", "$", "-", "<|endoftext|>", "the", "ing", " "]


def test_words_against_library(enc):
    r = random.Random(1)
    for _ in range(4_000):
        t = "".join(r.choice(PIECES) for _ in range(r.randrange(14)))
        assert enc.encode(t) == library(enc, t), repr(t)
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert enc.decode(ids).decode() == enc.tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["ab", "the ", "aé1.", "abcdefghij", "a'sre", "1a!", "!?", "x"])
def test_tree_against_library(enc, alphabet, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 24)
    r = random.Random(len(alphabet))
    for _ in range(60):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 500)))
        leaf = r.choice([1, 7, 40, 120])
        parts = [bpe.Part(enc, p) for p in bpe.leaves(t, leaf)]
        assert bpe.join_tree(enc, parts) == library(enc, t), repr(t)
        run = "".join(t.split()) or "x"
        half = len(run) // 2
        assert bpe.joined_run(enc, run[:half], run[half:], width=4)[0].astype("<u4").tobytes() == library(enc, run)


def test_documents(spark, docs, empty, texts, tokenizer, enc):
    got = sorted(((r["doc_id"] or 0, bytes(r["ids"])) for r in bpe.encode_documents(docs, tokenizer, leaf=1_000).collect()))
    assert got == sorted(((d or 0, library(enc, t or "")) for d, t in texts))
    digest = bpe.digests(bpe.encode_documents(docs, tokenizer), tokenizer)
    assert digest.count() == len(texts) and {r["n_tokens"] for r in digest.where("doc_id in (3, 4, 5)").collect()} == {0}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_documents(docs, tokenizer), tokenizer).collect()}
    assert back[10] == "one</w>" and back[3] == ""
    assert bpe.encode_documents(empty, tokenizer).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, empty, texts, tokenizer, enc):
    rows = packing.pack_documents(docs, tokenizer, capacity=64).collect()
    check_packing(rows, 64)
    want = []
    for d, t in texts:
        ids = library(enc, t or "") + b"\0\0\0\0"
        want += [(d or 0, k, k * 64, min(64, len(ids) // 4 - k * 64), zlib.crc32(ids[k * 256 : k * 256 + 256])) for k in range(-(-len(ids) // 256))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert packing.pack_documents(empty, tokenizer).count() == 0
    whole = packing.sequences(docs, tokenizer, capacity=64).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(w[3] for w in want) and max(len(r["ids"]) for r in whole) <= 64


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = random.Random(seed)
    hist = {n: r.randrange(1, 400) for n in r.sample(range(1, 513), r.choice([3, 40, 300]))}
    rows = packing.plan(hist, 512, groups=128)
    placed, bins = {}, {}
    for n, rank, count, each, first, offset in rows:
        for t in range(count):
            assert (n, rank + t) not in placed
            placed[n, rank + t] = 1
            bins.setdefault(first + t // each, []).append((offset + t % each * n, n))
    assert len(placed) == sum(hist.values())
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    free: list[int] = []  # best fit, longest first
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        k = min((k for k, f in enumerate(free) if f >= n), key=free.__getitem__, default=None)
        if k is None:
            free.append(512 - n)
        else:
            free[k] -= n
    assert len(bins) <= len(free) + 1


def test_hot_length_is_ranked_by_salt(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    p = spark.range(300).selectExpr("id as doc_id", "0 as piece", "case when id < 200 then 30L else id % 50 + 1 end as length")
    rows = packing.pack(p, 64, 8).collect()
    assert len(rows) == 300 and check_packing(rows, 64) >= sum(r["length"] for r in rows) / 64


def test_a_tokenizer_of_other_rules(spark, docs, texts, tokenizer):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cadenza.llm import wordbpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert wordbpe.by_words(tokenizer) and not wordbpe.by_words(path)
    tok = Tokenizer.from_file(path)
    got = sorted((x["doc_id"] or 0, bytes(x["ids"])) for x in bpe.encode_documents(docs, path, leaf=50).collect())
    ids = [(d or 0, tok.encode(t or "", add_special_tokens=False).ids) for d, t in texts]
    assert got == sorted((d, np.array(x, "<u4").tobytes()) for d, x in ids)
    decoded = sorted((x["doc_id"] or 0, x["text"]) for x in bpe.decode_ids(bpe.encode_documents(docs, path), path).collect())
    assert decoded == sorted((d, tok.decode(x, skip_special_tokens=False)) for d, x in ids)
