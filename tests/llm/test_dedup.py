import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cadenza.llm import common, exact, passages, simhash


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    nodes = {x for a, b in links for x in (a, b) if a != b}
    got = {x["node"]: x["component"] for x in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])


def test_components_of_nothing(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,bits", [(0, 20), (1, 20), (500, 20), (5_000, 40), (1_000, 10)])
def test_golomb(n, bits):
    v = np.unique(np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint64))
    code, k = exact.golomb_encode(v, bits)
    assert (exact.golomb_decode(code, k, len(v)) == v).all()
    if n >= 500 and bits < 30:
        assert len(code) * 8 < len(v) * bits


def test_exact(docs, empty, texts):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in texts]
    group = {}
    for d, t in norm:
        group.setdefault(t, []).append(d)
    want = sorted((d or 0, min((x for x in group[t] if x is not None), default=None) or 0, len(group[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
    rows = exact.exact_groups(docs, rows_a_sender=2).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["text_sha256"]) for r in rows) == want
    assert all(r["kept"] == (r["keep_id"] == r["doc_id"]) for r in rows)
    assert exact.exact_groups(empty).count() == 0


def plain_simhash(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, texts):
    r = random.Random(5)
    for _ in range(50):
        t = " ".join(r.choice("ab c dé F".split()) for _ in range(r.randrange(12)))
        assert simhash.simhash(t) == plain_simhash(t)
    fp = [(d, plain_simhash(t or "")) for d, t in texts]
    comp = components(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i][1] ^ fp[j][1]).bit_count() <= 2])
    least = {}
    for i, (d, _) in enumerate(fp):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    want = sorted((d or 0, f"{f:016x}", least.get(comp[i]) or 0) for i, (d, f) in enumerate(fp))
    got = simhash.near_groups(docs).collect()
    assert sorted((x["doc_id"] or 0, x["fingerprint"], x["component_id"] or 0) for x in got) == want
    assert simhash.near_groups(empty).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    made = [base]
    for _ in range(6):
        flips = (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))
        made.append(r.choice(np.concatenate(made), 60) ^ flips)
    v = np.unique(np.concatenate(made)).view(np.int64)
    want = components(v.tolist(), [(int(a), int(b)) for i, a in enumerate(v) for b in v[:i] if (int(a) ^ int(b)).bit_count() <= 2 or ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 2])
    df = spark.createDataFrame([(int(x),) for x in v], "fingerprint long")
    links = [(x["a"], x["b"]) for x in simhash.links(df).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() >= 1 for a, b in links)
    got = components(v.tolist(), links)
    assert {frozenset(k for k in got if got[k] == c) for c in set(got.values())} == {frozenset(k for k in want if want[k] == c) for c in set(want.values())}


def test_compact_windows_are_the_tree():
    r = random.Random(2)
    for _ in range(60):
        seqs = [[r.randrange(1, r.choice([6, 1000])) for _ in range(r.randrange(0, 40))] for _ in range(3)]
        least = r.choice([1, 2, 5, 9])
        bounds = np.cumsum([0, *map(len, seqs)])
        got = sorted(zip(*[x.tolist() for x in passages.compact_windows(np.array(sum(seqs, []), np.uint64), bounds, least)], strict=True))
        want = []

        def split(lo, hi, v, want=want, least=least):
            if hi - lo + 1 >= least and hi >= lo:
                c = min(range(lo, hi + 1), key=lambda i: (v[i], i))
                want.append((lo, c, hi))
                split(lo, c - 1, v)
                split(c + 1, hi, v)

        flat = sum(seqs, [])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            split(int(a), int(b) - 1, flat)
        assert got == sorted(want)


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(7))


def test_passages(spark):
    r = random.Random(9)
    text = lambda n: [word(r) for _ in range(n)]
    shared, near = text(55), text(90)
    changed = near.copy()
    changed[40] = "other"
    docs = [(i, " ".join(text(120))) for i in range(30)]
    docs += [(100 + i, " ".join(text(20 + i) + shared + text(30))) for i in range(6)]
    docs += [(200, " ".join(text(40) + near + text(10))), (201, " ".join(text(5) + changed + text(60)))]
    same = " ".join(text(80))
    docs += [(300, same), (301, same), (302, None), (303, "short"), (None, same), (300, same)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = passages.repeated_passages(df).collect()
    links = [(x["doc_id"] or 0, x["other_doc_id"] or 0) for x in rows]
    comp = components({x for p in links for x in p}, links)
    groups = {frozenset(k for k in comp if comp[k] == c) for c in set(comp.values())}
    assert groups == {frozenset(range(100, 106)), frozenset((200, 201)), frozenset((0, 300, 301))}
    words = {d: (t or "").split() for d, t in docs}
    for x in rows:
        for p in x["passages"]:
            a, b = words[x["doc_id"]][p["start_word"] : p["end_word"]], words[x["other_doc_id"]][p["other_start_word"] : p["other_end_word"]]
            s, t = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (a, b))
            assert len(s & t) / len(s | t) >= 0.8 and len(a) >= 50
        if {x["doc_id"], x["other_doc_id"]} <= set(range(100, 106)):
            assert any(set(shared) <= set(words[x["doc_id"]][p["start_word"] : p["end_word"]]) for p in x["passages"])
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_best_stretch():
    r = random.Random(4)
    for _ in range(200):
        v = np.array([r.random() < 0.8 for _ in range(r.randrange(1, 40))])
        got = passages.best_stretch(v, 0.9, 3)
        want = max((j - i for i in range(len(v)) for j in range(i + 3, len(v) + 1) if v[i:j].mean() >= 0.9), default=0)
        assert (got[1] - got[0] if got else 0) == want


def edited(r, n, put_in=0, left_out=0):
    """A passage of n words, and the same with words put in or left out in its middle."""
    one = [word(r) for _ in range(n)]
    return one, one[: n // 2] + [word(r) for _ in range(put_in)] + one[n // 2 + left_out :]


EDITS = [(60, 1, 0), (60, 0, 1), (75, 2, 0), (95, 0, 3), (120, 8, 0), (160, 0, 12)]


@pytest.mark.parametrize("n,put_in,left_out", EDITS)
@pytest.mark.parametrize("seed", range(5))
def test_shifted_passages_are_verified(n, put_in, left_out, seed):
    r = random.Random(seed)
    one, two = edited(r, n, put_in, left_out)
    a, b = ([w.encode() for w in [word(r) for _ in range(r.randrange(20, 60))] + x + [word(r) for _ in range(r.randrange(20, 60))]] for x in (one, two))
    found = passages.verified(a, b, 46, 0.8)
    assert len(found) == 1
    i, j, k, e, sim = found[0]
    s, t = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (a[i:j], b[k:e]))
    assert sim == pytest.approx(len(s & t) / len(s | t)) and sim >= 0.8
    assert {one[0].encode(), one[-1].encode()} <= set(a[i:j]) & set(b[k:e])


def test_shifted_passages(spark):
    """Insertions and deletions inside unrelated texts, all pairs against brute force."""
    r = random.Random(21)
    docs, want = [(i, " ".join(word(r) for _ in range(150))) for i in range(20)], set()
    for k, edit in enumerate(EDITS * 3):
        for side, x in enumerate(edited(r, *edit)):
            docs.append((100 + 2 * k + side, " ".join([word(r) for _ in range(r.randrange(20, 60))] + x + [word(r) for _ in range(r.randrange(20, 60))])))
        want.add((100 + 2 * k, 101 + 2 * k))
    got = {tuple(sorted((x["doc_id"], x["other_doc_id"]))) for x in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got <= want and len(got) >= len(want) - 1  # each is a candidate with a probability of about 0.97


def exact_groups_of(docs, n=50):
    """Components of documents that have n words in a row in common, by brute force."""
    at, links = {}, []
    for d, t in docs:
        w = t.lower().split()
        for i in range(len(w) - n + 1):
            links.append((d, at.setdefault(tuple(w[i : i + n]), d)))
    comp = components([d for d, _ in docs], [x for x in links if x[0] != x[1]])
    groups = {}
    for d, c in comp.items():
        groups.setdefault(c, set()).add(d)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def rows_groups(rows):
    links = [(x["doc_id"], x["other_doc_id"]) for x in rows]
    comp = components({x for p in links for x in p}, links)
    return {frozenset(k for k in comp if comp[k] == c) for c in set(comp.values())}


@pytest.mark.parametrize("seed", range(10))
def test_a_common_sentence_hides_no_passage(spark, seed):
    """300 documents hold a sentence of 35 words; two of them repeat a passage of 55 words around it, and three others one of 50 beside it."""
    r = random.Random(seed)
    text = lambda n: [word(r) for _ in range(n)]
    sentence = text(35)
    docs = [(i, " ".join(text(r.randrange(5, 60)) + sentence + text(r.randrange(5, 60)))) for i in range(300)]
    passage = text(9) + sentence + text(11)
    docs += [(i, " ".join(text(30) + passage + text(25))) for i in (1000, 1001)]
    other = sentence[20:] + text(35)
    docs += [(i, " ".join(text(12) + sentence[:20] + other + text(14))) for i in (2000, 2001, 2002)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {frozenset((1000, 1001)), frozenset((2000, 2001, 2002))} <= rows_groups(rows)
    assert rows_groups(rows) == exact_groups_of(docs)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_passages(spark, seed):
    """Passages that overlap in part, families of edited copies and lines of many documents against brute force."""
    r = random.Random(100 + seed)
    text = lambda n: [word(r) for _ in range(n)]
    long, line = text(200), text(30)
    docs = []
    for i in range(60):
        a = r.randrange(0, 150)
        docs.append((i, " ".join(text(20) + (long[a : a + r.randrange(40, 70)] if i % 3 else line) + text(25) + (line if i % 2 else []) + text(8))))
    base = text(160)
    for i in range(40):
        one = base.copy()
        for _ in range(r.randrange(1, 5)):
            one[r.randrange(160)] = word(r)
        docs.append((100 + i, " ".join(one)))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    found = rows_groups(rows)
    for g in exact_groups_of(docs):
        assert any(g <= f for f in found)
    words = {d: t.split() for d, t in docs}
    for x in rows:
        for p in x["passages"]:
            a, b = words[x["doc_id"]][p["start_word"] : p["end_word"]], words[x["other_doc_id"]][p["other_start_word"] : p["other_end_word"]]
            s, t = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (a, b))
            assert len(s & t) / len(s | t) >= 0.8 and len(a) >= 50


def test_alike_passages_are_found(spark):
    """Pairs at a similarity of 0.8 to 0.9, in texts that all hold a common line, against all that were planted."""
    r = random.Random(77)
    text = lambda n: [word(r) for _ in range(n)]
    line, docs, want = text(25), [], set()
    for k in range(60):
        n = r.choice([60, 80, 120])
        one = text(n)
        two = one.copy()
        for j in range(n // 60):
            two[n * (2 * j + 1) // (2 * (n // 60))] = word(r)
        docs += [(1000 + 2 * k + s, " ".join(text(30) + x + text(10) + line + text(10))) for s, x in enumerate((one, two))]
        want.add((1000 + 2 * k, 1001 + 2 * k))
    got = {tuple(sorted((x["doc_id"], x["other_doc_id"]))) for x in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_passages_with_columns_of_their_own_names(spark):
    r = random.Random(3)
    same = " ".join(word(r) for _ in range(70))
    rows = [(1, same, "x", 1, 2, 3), (2, same + " more", None, 4, None, 6), (2, same + " more", "y", 7, 8, 9), (3, None, "z", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, a long, lo int, key int")
    got = passages.repeated_passages(df).collect()
    assert [(x["doc_id"], x["other_doc_id"], x["longest_words"]) for x in got] in ([(1, 2, 70)], [(2, 1, 70)])


def test_stretch_hashes():
    v = np.random.default_rng(3).integers(0, 1 << 63, 300, dtype=np.uint64)
    v[200:260] = v[20:80]
    h = passages.stretch_hashes(v, 46)
    assert len(h) == 255 and [i for i in range(100, 255) if h[i] in h[:100]] == list(range(200, 215))


def plain_regions(links, least, agree):
    """Each link looks at all stretches before it, the latest first."""
    out = []
    for lo, hi, shift, fns in sorted((min(x["lo"], x["hi"]), max(x["lo"], x["hi"]) + least - 1, x["shift"], x["fns"] | x["hot"]) for x in links):
        for r in out[::-1]:
            if lo <= r[1] + 1 and abs(shift - r[2][-1]) <= passages.reach(max(hi, r[1]) - r[0] + 1):
                r[1], r[3] = max(r[1], hi), r[3] | fns
                r[2].append(shift)
                break
        else:
            out.append([lo, hi, [shift], fns])
    return sorted({(max(0, lo), hi, sorted(shifts)[len(shifts) // 2]) for lo, hi, shifts, fns in out if fns.bit_count() >= agree})


def test_regions_among_decoys():
    """Three links that agree make one stretch, however many links of other offsets lie between them."""
    link = lambda lo, shift, fns: {"lo": lo, "hi": lo, "shift": shift, "fns": fns, "hot": 0}
    mine = [link(100, 7, 1), link(101, 7, 2), link(102, 7, 4)]
    decoys = [link(100 + i // 9, 1000 * (i + 1), 8) for i in range(18)]
    assert passages.regions(mine, 46, 3) == passages.regions(mine + decoys, 46, 3) != []
    for seed in range(60):
        r = random.Random(seed)
        links = [link(r.randrange(400), r.choice([0, 3, 11, 40, 90, 300, 301, r.randrange(2000)]), 1 << r.randrange(5)) for _ in range(r.randrange(1, 260))]
        assert passages.regions(links, 46, 3) == plain_regions(links, 46, 3)


def family(n: int, seed: int) -> tuple[list[tuple[int, str]], dict[int, list[bytes]]]:
    """Texts around copies of one passage of 100 words with two words changed in each, and their words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = [word() for _ in range(100)]
    docs = []
    for i in range(n):
        own = passage[:]
        for j in rng.sample(range(100), 2) if i else ():
            own[j] = word()
        docs.append((i * 7 + 3, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
    rng.shuffle(docs)
    return docs, {i: passages.word_list(t) for i, t in docs}


@pytest.mark.parametrize("n, seed", [(60, 1), (60, 2), (60, 3), (300, 4)])
def test_families_of_edited_copies(spark, n, seed):
    docs, words = family(n, seed)
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    got = {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in rows}
    assert len(got) == len(rows)
    for r in rows:
        for p in r["passages"]:
            assert p["similarity"] >= 0.8 and p["end_word"] - p["start_word"] >= 50
    found = components(words, got)
    alike_to_one = {a for a in words if any(passages.verified(words[a], words[b], 46, 0.8) for b in words if b != a)}
    assert {found[a] for a in alike_to_one} == {3}


def test_pairs_of_several_rounds_are_one(spark):
    p = lambda i, j, k, e: {"start_word": i, "end_word": j, "other_start_word": k, "other_end_word": e, "similarity": 0.9}
    schema = passages.PAIR
    one = spark.createDataFrame([(1, 2, 10, 20, [p(0, 60, 5, 65)], 60), (1, 3, 10, None, [p(0, 50, 0, 50)], 50)], schema)
    two = spark.createDataFrame([(1, 2, 10, 20, [p(0, 60, 5, 65), p(0, 70, 5, 75), p(100, 150, 90, 140)], 70)], schema)
    got = {(r["a"], r["b"]): r for r in passages.merged([one, two]).collect()}
    assert set(got) == {(1, 2), (1, 3)} and got[1, 3]["other_doc_id"] is None and got[1, 3]["longest_words"] == 50
    assert [(x["start_word"], x["end_word"]) for x in got[1, 2]["passages"]] == [(0, 70), (100, 150)] and got[1, 2]["longest_words"] == 70


def test_no_pair_of_a_large_family_is_left_out(spark):
    """Every two of 150 edited copies that share a passage come out, not only a tree over them; 0.94 of those alike are met by the functions' odds."""
    docs, words = family(150, 5)
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    got = {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in rows}
    ids = sorted(words)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if passages.verified(words[a], words[b], 46, 0.8)}
    assert len(got) == len(rows) and len(got & want) >= 0.9 * len(want) > 3_000


@pytest.mark.parametrize("n", [40, 200])
def test_tiles_link_all_of_a_key_once(spark, n):
    """Against all pairs made here: rows of one key of many texts, of one of few, and of an exact stretch."""
    r = random.Random(n)
    laid = [(passages.TOGETHER_KEY, 1, u, r.randrange(50), 0, 40, 7, 0) for u in range(n)] + [(passages.TOGETHER_KEY, 2, u, 5, 0, 9, 11, 0) for u in range(9)] + [(passages.EXACT, 3, u, 5, 5, 5, 31, 0) for u in range(n)]
    laid = spark.createDataFrame(laid, passages.OVERLAY).repartition(3)
    links = passages.linked(laid, passages.heads_of(laid)).collect()
    at = {x["uid"]: x["at"] for x in laid.where("key = 1").collect()}
    want = {(a, b, at[b] - at[a]) for a in range(n) for b in range(a + 1, n)} | {(a, b, 0) for a in range(9) for b in range(a + 1, 9)} | {(0, b, 0) for b in range(1, n)}
    assert {(x["a"], x["b"], x["shift"]) for x in links} == want and len(links) == len(want)


def ids_of(rows):
    return {(d, x["class_id"]) for x in rows for d in (x["doc_id"], x["other_doc_id"])}


@pytest.mark.parametrize("cell", [16, 1024])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, cell):
    """Families of edited copies, texts of a common line and copies: classes as from all pairs, while rows grow as the texts and not as their pairs."""
    monkeypatch.setattr(passages, "CELL", cell)
    r = random.Random(8)
    text = lambda n: [word(r) for _ in range(n)]
    docs, words = family(150, 5)
    line = text(20)
    docs += [(5000 + i, " ".join(text(40) + line + text(40))) for i in range(120)]
    same = " ".join(text(80))
    docs += [(7000, same), (6999, same), (None, same), (7001, None), (7002, "a " * 300), (7003, "a " * 300 + "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    every, rows = passages.repeated_passages(df).collect(), passages.passage_classes(df).collect()
    of = lambda found: components({x or 0 for p in found for x in (p["doc_id"], p["other_doc_id"])}, [(x["doc_id"] or 0, x["other_doc_id"] or 0) for x in found])
    assert of(rows) == of(every)
    assert {d for d, c in ids_of(rows) if c == 3} >= set(words) and {d for d, c in ids_of(rows) if c == 6999} == {7000, 6999, None}
    assert len(every) > 3_000 and len(rows) < 2 * len(docs)
    for x in rows:
        for p in x["passages"]:
            assert p["similarity"] >= 0.8 and p["end_word"] - p["start_word"] >= 50


@pytest.mark.parametrize("seed", range(2))
def test_classes_of_overlapping_passages(spark, seed):
    r = random.Random(100 + seed)
    text = lambda n: [word(r) for _ in range(n)]
    long, line = text(200), text(30)
    docs = []
    for i in range(60):
        a = r.randrange(0, 150)
        docs.append((i, " ".join(text(20) + (long[a : a + r.randrange(40, 70)] if i % 3 else line) + text(25) + (line if i % 2 else []) + text(8))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = rows_groups(passages.passage_classes(df).collect())
    assert found == rows_groups(passages.repeated_passages(df).collect())
    assert all(any(g <= f for f in found) for g in exact_groups_of(docs))
    assert passages.passage_classes(df.limit(0)).count() == 0


def test_sketches_exclude_nothing_that_is_found():
    """Passages of few different words share few bits; whatever is found in the stretches around shared minima, the sketches let it through."""
    r = random.Random(3)
    least, found, few = 46, 0, 0
    for i in range(600):
        kinds = [word(r) for _ in range((6, 12, 40, 400)[i % 4])]
        body = [r.choice(kinds[:2] if i % 8 == 0 else kinds) for _ in range(r.randrange(50, 75))]
        side = lambda: [word(r) for _ in range(r.randrange(0, 30))]
        edited = [w if r.random() > 0.02 * (i % 5) else word(r) for w in body]
        texts = [[w.encode() for w in side() + x + side()] for x in (body, edited)]
        w = passages.Windows([passages.shingle_hashes(t) for t in texts], least, 5)
        if (np.diff(w.bounds) < least).any():
            continue
        lo = w.bounds[:-1]
        bits, again, merged = passages.sketches(w, lo, w.bounds[1:] - least)
        shared = int(np.bitwise_count(bits[0] & bits[1]).sum())
        if passages.verified(texts[0], texts[1], least, 0.8):
            found += 1
            few += shared < min(28, int(np.bitwise_count(bits).sum(axis=1).min()) // 2)
            assert shared >= passages.least_common(again[:1], merged[:1], again[1:], merged[1:], least, 0.8)[0]
    assert found > 200 and few > 0  # which a fixed number of bits would have left out


def test_a_row_for_each_member(spark):
    docs, words = family(60, 2)
    docs += [(9000, None), (9001, "one " * 70), (9002, "one " * 70)]
    links = passages.passage_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    rows = passages.members(links).collect()
    assert sorted(x["doc_id"] for x in rows) == sorted({d for x in links.collect() for d in (x["doc_id"], x["other_doc_id"])})
    assert {x["doc_id"] for x in rows if x["class_id"] == 3} >= set(words) and {x["doc_id"] for x in rows if x["class_id"] == 9001} == {9001, 9002}
    text = dict(docs)
    for x in rows:
        a, b = (passages.word_list(text[x[c]]) for c in ("doc_id", "other_doc_id"))
        assert x["n_links"] >= 1 and x["longest_words"] >= 50
        for p in x["passages"]:
            assert passages.jaccard(passages.shingle_hashes(a[p["start_word"] : p["end_word"]]), passages.shingle_hashes(b[p["other_start_word"] : p["other_end_word"]])) >= 0.8


def test_a_family_is_joined_by_few_links(spark):
    """Of edited copies that share keys each meets the first one; what is left to compare among all doesn't grow with the square of the family."""
    made = []
    for n in (100, 400):
        docs, _ = family(n, 6)
        rows, classes, laid = passages.laid_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text", 50, 5, 3, True)
        nobody = spark.createDataFrame([], "node long, component long")
        heads = passages.candidate_pairs(passages.summed(passages.beside_heads(passages.apart(laid, nobody), 46, 0.8)), 46, 3)
        pairs = passages.written(passages.verified_pairs(heads, rows, classes, 46, 0.8), "pairs")
        met = passages.connected_components(pairs.select("a", "b"))
        made.append((heads.count(), passages.across(passages.apart(laid, met), 46, 0.8).count()))
        assert met.count() > 0.9 * n
    assert made[1][0] < 8 * made[0][0] and made[1][1] < 8 * max(made[0][1], 50)


@pytest.mark.parametrize("share", [0, 0.001, 0.03, 0.5, 1])
def test_packed_sketches(share):
    rng = np.random.default_rng(4)
    bits = rng.random((3000, passages.SKETCH)) < share
    bits[0], bits[1], bits[2] = False, False, True
    bits[1, [0, 254, 255, 510, 1020, passages.SKETCH - 1]] = True
    whole = np.packbits(bits, axis=1)
    steps, n = passages.packed(whole)
    ends = np.cumsum(n)
    column = pa.array([steps[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())
    assert ends[-1] == len(steps) and (passages.bits_of(column) == whole.view(np.uint64)).all()
    assert passages.bits_of(column[:0]).shape == (0, passages.SKETCH // 64)
