import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import alignment, divergence, rules
from cadenza.llm.queries import tokenizer_path

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, times = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        docs[lang].update(set(terms))
        times[lang, source].update(terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        count = {s: [times[lang, s][t] for t in kept] for s in sources}
        whole = [sum(count[s][i] for s in sources) for i in range(len(kept))]
        p = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        price, q = {s: p(count[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(map(f, price[s], price[o])), o.encode()) for o in sources if o != s]
            terms = [(-f(a, b), t.encode()) for a, b, t, n in zip(price[s], q, kept, count[s], strict=True) if n and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_audit(spark, monkeypatch, seed, small):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(60)] + ["THE", "the", "ÄÖ", "äö"]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "cé", "z", None]), r.choice([" ", "\n", "1", "_", "\x00"]).join(r.choices(words, range(64, 0, -1), k=r.randrange(40))) or None) for _ in range(150)]
    rows += [("xx", "only", "the the"), ("yy", "a", ""), ("yy", "b", None), ("en", "a", "the " * 3_000)]
    if small:
        for name, value in (("ENTRIES", 40), ("AT_ONCE", 30), ("CHUNK", 25), ("CELLS", 8), ("ROWS", 7)):
            monkeypatch.setattr(divergence, name, value)
    assert audited(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5), least_docs=4, top=5) == plain_audit(rows, 4, 5)


def test_small_batches(spark):
    """Terms and chunks that go over many batches."""
    rows = [("en", f"s{i % 9}", f"common t{chr(97 + i % 20)} t{chr(97 + i % 7)}") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert audited(df, least_docs=3) == plain_audit(rows, 3, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_audit_of_edges(spark, docs, empty, texts):
    rows = [(None if i % 2 else "en", "src", t) for i, (_, t) in enumerate(texts)]
    assert audited(docs, least_docs=2) == plain_audit(rows, 2, 10)
    assert audited(empty) == []


def test_price_is_exact():
    r = random.Random(0)
    for _ in range(300):
        total, terms = r.randrange(10**15), r.randrange(1, 10**8)
        count = r.randrange(total + 1)
        assert int(divergence.price(np.int64(count), np.int64(total), terms)) == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    held = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held), n < 10 or 100 * len(held) > 20 * n


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def junk(r, low):
    words = [f"{chr(97 + r.randrange(26))}{r.randrange(1000)}" + r.choice(["***", "|", "&&"]) * low for _ in range(r.randrange(30, 80))]
    return " ".join(words)


def test_statistics(spark, docs, empty, texts):
    r = random.Random(5)
    more = ["a b c d e " * 2, "a b c d e f g", "a a a a a a", "x\ny\nx\n \n \nx\r\ny", "\x0b\x0c\r\n", "a b c d e x a b c d e", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6\xa07", "\x00 # < > ▁ \x85 a", ""]
    more += [" ".join(r.choices("abc", k=r.randrange(60))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame, want in ((df, list(enumerate(more))), (docs, texts)):
        got = [tuple(x[c] for c in ("doc_id", *STATISTICS, "base_failed")) for x in rules.judge(frame, labels).collect()]
        assert sorted(map(repr, got)) == sorted(repr((d, *plain_statistics(t))) for d, t in want)
    assert rules.judge(empty, labels).count() == 0


def test_list_is_learnt(spark):
    """Rules come out in their order, hold for documents that were not labelled, and say what they do."""
    r = random.Random(9)
    kind = [i % 4 for i in range(480)]  # 0: symbols, 1: shouting, else clean
    texts = [junk(r, 1) if k == 0 else junk(r, 0).upper() if k == 1 else junk(r, 0) for k in kind]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, low string").repartition(3)
    labels = spark.createDataFrame([(i, int(kind[i] > 1), 1) for i in range(240)] + [(1, None, 1), (7, 1, 0), (None, 0, 0), (0, 0, 5)], "doc_id long, quality int, text int")
    stats = rules.measured(df)
    learnt = rules.learn(stats, labels)
    assert 2 <= len(learnt.rules) <= 4 and all(x.low >= 0.9 * x.covered for x in learnt.rules)
    got = {x["doc_id"]: x for x in rules.judge(df, labels).collect()}
    assert [got[i]["kept"] for i in range(480)] == [k > 1 for k in kind]
    assert {x["rule"] for x in got.values()} == {str(x) for x in learnt.rules} | {None}
    assert str(learnt).endswith("\nkeep") and str(learnt).startswith(f"if {learnt.rules[0]} then drop")
    # the same rule list whatever the partitions
    assert rules.learn(rules.measured(df.repartition(1)), labels) == learnt


@pytest.mark.parametrize("one", [0, 1, None])
def test_labels_of_one_kind(spark, docs, one):
    labels = spark.createDataFrame([(d, one) for d in range(12)], "doc_id long, quality int")
    assert all(x["kept"] != x["base_failed"] for x in rules.judge(docs, labels).collect())


def test_held_out(spark):
    """Labels of other documents than those that were learnt from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = rules.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = [x["kept"] == (x["quality"] == 1) for x in out if not x["base_failed"]]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
    assert all(x["quality"] == 0 for x in out if x["rule"])  # the base rule is given, and drops some good ones


@pytest.fixture(scope="module")
def both():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_alignment(texts, path_a, path_b):
    """Token by token, with the tokenizers library."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    assert decoders.ByteLevel().decode(list(alphabet)[:40]) == bytes(list(alphabet.values())[:40]).decode()
    linked, count = [], Counter()
    for t in texts:
        one = None
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            bytes_a = [w.encode() if w == "<|endoftext|>" else bytes(alphabet[c] for c in w) for w in map(a.id_to_token, ids_a)]
            bytes_b = list(map(piece, ids_b))
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + t.encode():
                spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
                sa, sb = spans(bytes_a), spans(bytes_b)
                links = [(ids_a[i], ids_b[j]) for i in range(len(sa)) for j in range(len(sb)) if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]]
                cuts = sorted({e for _, e in sa} & {e for _, e in sb})
                groups, low = [], 0
                for c in cuts:
                    groups.append("|".join(",".join(str(i) for i, s in zip(ids, sp, strict=True) if low < s[1] <= c) for ids, sp in ((ids_a, sa), (ids_b, sb))))
                    low = c
                one = (len(sa), len(sb), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                count.update(set(links))
        linked.append(one)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for x in linked]


@pytest.mark.parametrize("most", [1, 200, alignment.BLOCK_LINKS])
def test_alignment(spark, both, most):
    r = random.Random(4)
    texts = ["hello world", "", None, "a", " ", "  two  blanks ", "tab\tand\nline\r\n", "▁ a", "naïve café 東京 😀😀", "<|endoftext|> and </s> <0x41>", "ﬁ ligature", "\x00nul", "é" * 30, "don't we'll I'VE", "a" * 300, " " * 40 + "x", "12345 67,890.5", "hello world"]
    texts += ["".join(r.choice("abc  \n.,1é漢'") for _ in range(r.randrange(1, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "n", 3) for i, t in enumerate(texts)], "doc_id long, text string, pair string, block int").repartition(3)
    got = sorted(map(tuple, alignment.align_documents(df, *both, block_links=most).collect()))
    assert got == [(i, *x) for i, x in enumerate(plain_alignment(texts, *both))]


def test_alignment_of_edges(spark, docs, empty, texts, both):
    some = docs.where("length(text) < 5000 or text is null")
    got = sorted(map(repr, (tuple(r) for r in alignment.align_documents(some, *both).collect())))
    kept = [(d, t) for d, t in texts if t is None or len(t) < 5000]
    assert got == sorted(repr((d, *x)) for (d, _), x in zip(kept, plain_alignment([t for _, t in kept], *both), strict=True))
    assert alignment.align_documents(empty, *both).count() == 0
    long = {r["doc_id"]: r for r in alignment.align_documents(docs.where("doc_id in (8, 9)"), *both).collect()}
    assert long[8]["n_a"] >= 9_000 and long[9]["n_links"] == long[9]["n_a"] + long[9]["n_b"] - long[9]["n_groups"]


def test_ranks_and_library_agree(both):
    """The quicker encoder of the same vocabulary against the tokenizers library, with long runs."""
    a, r = alignment.ByteTokens(both[0]), random.Random(2)
    assert a.fast is not None
    for text in ["x" * 70_000, " " * 70_000, "ab " * 20_000, *("".join(chr(r.choice([32, 10, 39, 65, 97, 48, 233, 0x4E00, 0x1F600, 0xA0, 0x85, 0])) for _ in range(300)) for _ in range(50))]:
        assert a.encode(text).tolist() == a.library.encode(" " + text, add_special_tokens=False).ids


def test_bits():
    r = np.random.default_rng(0)
    places = np.unique(r.integers(0, 500, 120))
    bits = alignment.Bits.of(places, 500)
    assert bits.select().tolist() == places.tolist()
    assert bits.rank(np.arange(500)).tolist() == [int((places < i).sum()) for i in range(500)]
