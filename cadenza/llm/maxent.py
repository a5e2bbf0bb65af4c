"""Language-model scoring with a hashed maximum-entropy model.

The next token's probability is that of its class times that of the token within its class; both are
softmaxes over weights of hashed features: a bias, the word before, the two words before as one (the
n-grams), and the second word before by itself (the skip); within a class the first two of them. The
commonest words have outcomes of their own; all other words share one, within which their corpus counts decide.

Training is distributed: the documents of a round are dealt to shards by a hash of their ids and texts. Each shard starts from the round's
weights and makes gradient steps on its documents in a fixed order; the changes of each weight row are averaged by how often shards saw it. Every
training document is used in one round, so the model depends on the documents and not on how they are stored or
how many tasks there are. Counts cover every training token.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_rows, written

#: Classes and outcomes in each; rows of hashed weights; rounds that the training documents are dealt to.
CLASSES, MEMBERS, ROWS, ROUNDS = 32, 32, 1 << 14, 3
#: Words with at least this share of all tokens are known to every task: so there are no more than its inverse.
COMMON = 2.0**-20
END, OTHER = 0, 1
FOLDS, HELD_OUT = 7, 2
#: Features of a class, and the first of them that also tell members of a class apart.
FEATURES, INNER = 4, 2
#: Documents of a shard, and most shards of a round: beyond that shards take more documents. Texts that become numbers together.
SHARD, MOST_SHARDS, TEXTS = 4_000, 1_024, 64
#: Distinct words that a counting task holds before it hands them on; tokens of a gradient step; weight rows of one message.
HELD_WORDS, STEP, CHUNK = 300_000, 4_096, 1_024
EDGE = -2  # stands for what is before a text
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def word_list(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def with_fold(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = text_rows(docs, id_col, text_col)
    return rows.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word binary, c long) over the texts of rows (text); tasks add up what they can hold first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(word_list(t))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def features(w1: np.ndarray, w2: np.ndarray) -> list[np.ndarray]:
    """Weight rows of each token's features, from the numbers of the two words before it."""
    a, b = ((w + 3).astype(np.uint64) for w in (w1, w2))
    m, top = MULTIPLIERS, np.uint64(64 - (ROWS.bit_length() - 1))
    return [np.zeros(len(w1), np.int64), *((h >> top).astype(np.int64) for h in (a * m[0], (a * m[1]) ^ (b * m[2] + m[0]) * m[3], b * m[2]))]


def in_class(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Weight rows of a feature within a class."""
    return (((rows * CLASSES + group).astype(np.uint64) * MULTIPLIERS[0]) >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.int64)


ONES = np.ones(CLASSES, np.float32)  # CLASSES == MEMBERS: a row's sum as a product, which is faster


class Weights:
    """Two tables of rows of 32 weights, and the fixed first guess: log shares of classes and of members in them."""

    def __init__(self, outcome_counts: np.ndarray):
        n = (outcome_counts + 0.5).reshape(CLASSES, MEMBERS)
        self.first = np.log(n.sum(1) / n.sum()).astype(np.float32), np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
        self.tables = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, MEMBERS), np.float32)]

    def bias(self) -> tuple[np.ndarray, np.ndarray]:
        """First guess and bias weights together: of the classes, and of the members of each class."""
        return self.first[0] + self.tables[0][0], self.first[1] + self.tables[1][in_class(np.zeros(CLASSES, np.int64), np.arange(CLASSES))]

    def logits(self, feats: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of all classes, and of the members of each token's own class; and the weight rows of the features within it. The first feature is the bias."""
        of_class, of_members = self.bias()
        inner = [in_class(f + ROWS * k, group) for k, f in enumerate(feats[:INNER])]
        z, y = self.tables[0].take(feats[1], axis=0), self.tables[1].take(inner[1], axis=0)
        z += of_class
        for f in feats[2:]:
            z += self.tables[0].take(f, axis=0)
        y += of_members.take(group, axis=0)
        return z, y, inner


def exps(z: np.ndarray) -> np.ndarray:
    """exp, shifted by each row's maximum only where it could overflow."""
    if z.size and z.max() > 60:
        z = z - z.max(1, keepdims=True)
    return np.exp(z)


def log_prob(z: np.ndarray, goal: np.ndarray) -> np.ndarray:
    if z.size and z.max() > 60:
        z = z - z.max(1, keepdims=True)
    return z[np.arange(len(goal)), goal].astype(np.float64) - np.log(np.exp(z) @ ONES)


def add_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values, and how often each came."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # ROWS fit in 16 bits, for which this is a radix sort
    rows = rows[order]
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[start], np.add.reduceat(values.take(order, axis=0), start, axis=0), np.diff(start, append=len(rows))


def contexts(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the next token and of the two before, for all texts of word numbers; -1 is a word that is not common, EDGE
    stands after (the end) and before each text."""
    size = np.array([len(x) for x in lists]) + 1
    flat = np.full(int(size.sum()) + 2, EDGE, np.int64)
    stop = np.cumsum(size)
    keep = np.ones(int(size.sum()), bool)
    keep[stop - 1] = False
    flat[2:][keep] = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum() - len(lists)))
    word = flat[2:]
    first = np.repeat(stop - size, size)
    at = np.arange(len(word))
    back = [np.where(at - k >= first, flat[2 - k : len(flat) - k], EDGE) for k in (1, 2)]
    return word, *back


class Vocabulary:
    """Common words by falling count. The first ones are outcomes; the end and the other words are two more."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, ends: int, distinct: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.log_c = np.log10(np.array([*counts, 0, ends], np.float64) + 1)  # at -1: the end; at -2: not common
        own = CLASSES * MEMBERS - 2
        self.outcomes = min(own, len(words))
        self.tokens, self.distinct = tokens, distinct
        top = np.array(counts[: self.outcomes], np.float64)
        self.counts = np.zeros(CLASSES * MEMBERS)
        self.counts[[END, OTHER]] = ends, max(0.0, tokens - ends - top.sum())
        self.counts[2 : 2 + self.outcomes] = top
        # probabilities of other words given that it is one: add-one over their types and one that was never seen
        self.log_rest = np.log10(max(1.0, tokens - ends - top.sum() + max(0, distinct - 1 - self.outcomes) + 1))

    def numbers(self, words: list[bytes]) -> list[int]:
        return list(map(self.number.get, words, repeat(-1)))

    def outcome(self, word: np.ndarray) -> np.ndarray:
        """EDGE is the end; common words past the outcomes, and others, are OTHER."""
        return np.where(word == EDGE, END, np.where((word >= 0) & (word < self.outcomes), word + 2, OTHER))


def shard_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """(shard, up to TEXTS of its texts) from rows (shard, text) that are sorted by shard, cut alike whatever the batches are."""
    own, held = None, []
    for b in batches:
        for shard, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and (shard != own or len(held) == TEXTS):
                yield own, held
                held = []
            own = shard
            held.append(text)
    if held:
        yield own, held


def train(rows: DataFrame, words: Vocabulary, rounds: int = ROUNDS, rate: float = 0.25) -> Weights:
    """rows (text, part int in 0..rounds-1, tie long), the training documents."""
    spark = rows.sparkSession
    weights = Weights(words.counts)
    shared = spark.sparkContext.broadcast(words)  # no more than 1 / COMMON words
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        shards = min(MOST_SHARDS, max(1, -(-sizes.get(k, 0) // SHARD)))

        def steps(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocab, old = shared.value, sent.value
            own = None

            def changes():
                for t, (table, before) in enumerate(zip(new.tables, old.tables, strict=True)):
                    for c in range(0, ROWS, CHUNK):
                        if seen[t][c : c + CHUNK].any():
                            change = (table[c : c + CHUNK] - before[c : c + CHUNK]).astype(np.float16)
                            yield pa.RecordBatch.from_arrays([pa.array([t * ROWS + c], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([seen[t][c : c + CHUNK].tobytes()], pa.binary())], ["chunk", "change", "seen"])

            def step(word, w1, w2):
                out = vocab.outcome(word)
                group, member = out // MEMBERS, out % MEMBERS
                feats = features(w1, w2)
                z, y, inner = new.logits(feats, group)
                for table, v, goal, where, n, sq in ((new.tables[0], z, group, feats, seen[0], square[0]), (new.tables[1], y, member, inner, seen[1], square[1])):
                    g = exps(v)
                    g *= (1 / (g @ ONES))[:, None]
                    g[np.arange(len(goal)), goal] -= 1
                    for k, f in enumerate(where):
                        r, total, times = (f[:1], g.sum(0, keepdims=True), len(f)) if k == 0 and goal is group else add_rows(f, g)
                        sq[r] += (total * total).mean(1)
                        table[r] -= rate / len(where) * total / np.sqrt(sq[r])[:, None]
                        n[r] += times

            for shard, texts in shard_texts(batches):
                if shard != own:
                    if own is not None:
                        yield from changes()
                    own = shard
                    new = Weights(vocab.counts)
                    new.tables = [t.copy() for t in old.tables]
                    seen = [np.zeros(ROWS, np.float32) for _ in new.tables]
                    square = [np.full(ROWS, 1e-6, np.float32) for _ in new.tables]
                cols = contexts([vocab.numbers(word_list(t)) for t in texts])
                for j in range(0, len(cols[0]), STEP):
                    step(*(c[j : j + STEP] for c in cols))
            if own is not None:
                yield from changes()

        def mean(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((CHUNK, CLASSES)), np.zeros(CHUNK)
            for b in batches:
                for change, seen in zip(b.column("change").to_pylist(), b.column("seen").to_pylist(), strict=True):
                    s = np.frombuffer(seen, np.float32).astype(np.float64)
                    total += np.frombuffer(change, np.float16).reshape(CHUNK, CLASSES).astype(np.float64) * s[:, None]
                    n += s
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], ["chunk", "change"])

        dealt = rows.where(F.col("part") == k).select(F.pmod(F.col("tie"), F.lit(shards)).cast("int").alias("shard"), "tie", "text")
        dealt = dealt.repartition("shard").sortWithinPartitions("shard", "tie", "text").select("shard", "text")
        deltas = dealt.mapInArrow(steps, "chunk int, change binary, seen binary")
        for r in deltas.groupBy("chunk").applyInArrow(mean, "chunk int, change binary").collect():  # 2 * ROWS rows of 32 weights at most
            t, c = divmod(r["chunk"], ROWS)
            weights.tables[t][c : c + CHUNK] += np.frombuffer(bytes(r["change"]), np.float32).reshape(CHUNK, CLASSES)
        sent.unpersist()
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows whose crc32(id as text) mod 7 is not 2. Null texts are empty (their end is a token), null
    ids stay, repeated rows count and are returned each time, an empty table gives an empty result. Uncommon words
    meet their counts by their XXH64; two that share one would be taken for one another.
    """
    spark = docs.sparkSession
    rows = with_fold(docs, id_col, text_col)
    learn = rows.where("not held_out").withColumns({"part": F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)), "tie": F.xxhash64("doc_id", "text", F.lit(9))})
    counts = written(word_counts(learn), "counts")
    ends = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    least = max(2, int(np.ceil(tokens * COMMON)))
    common = [(bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).toLocalIterator()]  # no more than 1 / COMMON
    common.sort(key=lambda x: (-x[1], x[0]))
    vocab = Vocabulary([w for w, _ in common], [c for _, c in common], tokens, ends, distinct)
    weights = train(learn.select("text", "part", "tie"), vocab, rounds) if ends else Weights(vocab.counts)
    shared = spark.sparkContext.broadcast((vocab, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        voc, model = shared.value
        base_log, ten = np.log10(voc.tokens + voc.distinct + 1), np.log(10.0)
        for b in batches:
            names, folds, texts = (b.column(i).to_pylist() for i in range(3))
            for i in range(0, len(texts), 64):
                lists = [word_list(t) for t in texts[i : i + 64]]
                numbers = [voc.numbers(x) for x in lists]
                word, w1, w2 = contexts(numbers)
                size = np.array([len(x) + 1 for x in lists])
                own = np.repeat(np.arange(len(lists)), size)
                known = (word >= 0) | ((word == EDGE) & (ends > 0))
                log_c = voc.log_c[np.where(word >= 0, word, np.where(word == EDGE, -1, -2))]
                out = voc.outcome(word)
                p = np.empty(len(word))
                for j in range(0, len(word), STEP):
                    cut = slice(j, j + STEP)
                    group, member = out[cut] // MEMBERS, out[cut] % MEMBERS
                    z, y, _ = model.logits(features(w1[cut], w2[cut]), group)
                    p[cut] = (log_prob(z, group) + log_prob(y, member)) / ten
                other = out == OTHER
                p += np.where(other, log_c - voc.log_rest, 0.0)
                sums = [np.bincount(own, x, len(lists)) for x in (known, log_c - base_log, p)]
                rare_words, rare_times = [], []
                for x, known_as in zip(lists, numbers, strict=True):
                    rare = Counter([w for w, k in zip(x, known_as, strict=True) if k < 0])
                    rare_words.append(np.array([xxh64_intdigest(w, 42) for w in rare], np.uint64).view(np.int64))
                    rare_times.append(list(rare.values()))
                n = len(lists)
                keys = np.frombuffer(os.urandom(8 * n), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(names[i : i + n], pa.int64()), pa.array(folds[i : i + n], pa.bool_()), pa.array(size.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(rare_words, pa.list_(pa.int64())), pa.array(rare_times, pa.list_(pa.int32()))],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "times"],
                )

    scored = written(rows.select("doc_id", "held_out", "text").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("_r")).select("row", F.col("_r.rare").alias("hash"), F.col("_r.times").alias("times"))
    # a word that was never counted adds nothing, so an inner join is enough
    seen = counts.where(F.col("c") < least).select(F.xxhash64("word").alias("hash"), F.col("c"))
    more = rare.join(seen, "hash").groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_log"))
    out = scored.drop("rare", "times").join(more, "row", "left")
    extra = F.coalesce("_log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))
