"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention (a tanh and a sigmoid branch)
weighs the encodings; the weighted sum is scored. Only document labels are needed to learn all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_rows, written

#: Bytes of a passage.
PASSAGE = 512
#: Bound of the training sample: labelled documents of each label. Every passage of each of them is encoded and learnt from.
MOST_LABELLED = 2_000
#: Gradient steps over the whole sample, their first size, and the decay of weights.
STEPS, RATE, DECAY = 70, 2e-2, 1e-4
#: Passages that one numpy call works on, a document more or less.
AT_ONCE = 2_048
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
HIDDEN, ATTENTION = 24, 12


def byte_kinds() -> np.ndarray:
    """A kind for each byte: lower, upper, digit, blank, line end, beyond ASCII (two), and nine kinds of punctuation."""
    kind = np.full(256, 15, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:", "!?", "'\"`", "()[]{}", "<>/\\", "|", "#$%&*@^~+=", "-_")):
        for c in chars:
            kind[ord(c)] = k
    kind[0x80:0xC0], kind[0xC0:] = 13, 14
    return kind


KINDS = byte_kinds()
FEATURES = 128 + 256 + 6


def passage_features(text: str) -> np.ndarray:
    """One row of numbers for each passage; an empty text has one passage of nothing.

    Frequencies of byte values below 128 and of pairs of byte kinds, as square roots, and six of the whole text: share of
    distinct words, of distinct lines, mean word and line length, length, share of the commonest word.
    """
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(raw):
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(raw) // PASSAGE)
    at = np.arange(len(raw)) // PASSAGE
    plain = raw < 128
    single = np.bincount(at[plain] * 128 + raw[plain], minlength=n * 128).reshape(n, 128)
    kind = KINDS[raw]
    pair = np.bincount(at[1:] * 256 + kind[:-1] * 16 + kind[1:], minlength=n * 256).reshape(n, 256)
    size = np.bincount(at, minlength=n)[:, None]
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    whole = [len(count) / (len(words) + 1), len(set(lines)) / (len(lines) + 1), min(3.0, len(raw) / (len(words) + 1) / 8), min(3.0, len(raw) / (len(lines) + 1) / 200), np.log1p(len(raw)) / 12, max(count.values(), default=0) / (len(words) + 1)]
    return np.hstack([np.sqrt(single / size), np.sqrt(pair / size), np.repeat([whole], n, axis=0)]).astype(np.float32)


class Model:
    """h = tanh(x W + b); attention = softmax over a bag of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(c . sum of attention * h + d)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": g(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, ATTENTION), "U": g(HIDDEN, ATTENTION), "w": g(ATTENTION), "c": g(HIDDEN), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, start: np.ndarray):
        """x: passages of all bags one after another; start: where each bag begins."""
        p = self.p
        size = np.diff(start, append=len(x))
        bag = np.repeat(np.arange(len(start)), size)
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        m = np.add.reduceat(a[:, None] * h, start)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return y, (z, h, t, s, a, m, bag)

    def gradient(self, x: np.ndarray, start: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of weighted log losses, which adds up over bags."""
        p = self.p
        y, (z, h, t, s, a, m, bag) = self.forward(x, start)
        dy = (y - label) * weight
        dm = dy[:, None] * p["c"]
        da = (dm[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, start)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dm[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": z.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": m.T @ dy, "d": dy.sum(keepdims=True)}

    def flat(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.asarray(values[k], np.float64).ravel() for k in self.p])

    def step(self, k: int, of: int, total: np.ndarray, state: list[np.ndarray], rate: float = RATE, decay: float = DECAY) -> None:
        """Adam's k-th step of `of`, from the mean gradient of all bags; its size falls to nothing in the end."""
        g = total + decay * self.flat(self.p)
        state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g
        move = rate * (1 - k / of) * (state[0] / (1 - 0.9 ** (k + 1))) / (np.sqrt(state[1] / (1 - 0.999 ** (k + 1))) + 1e-8)
        at = 0
        for name, v in self.p.items():
            self.p[name] = (v - move[at : at + v.size].reshape(v.shape)).astype(np.float32)
            at += v.size

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        some: list[np.ndarray] = []
        for i, t in enumerate(texts):
            some.append(passage_features(t))
            if sum(map(len, some)) > AT_ONCE or i == len(texts) - 1:
                out.append(self.forward(np.concatenate(some), np.cumsum([0, *map(len, some[:-1])]))[0])
                some = []
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Learn from rows whose crc32(id as text) mod 5 is not 0.

    At most `most` documents of each label, those whose ids have the smallest hashes, weighted back to the labels' true shares. Null
    labels are left out; a document labelled more than once has its smallest label. Without documents of both labels
    the model is untrained but for its prior, so that it keeps what it can't judge.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("label").alias("label"))
    total = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    parts = [marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionAll(parts[1]))  # 2 * `most` rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [passage_features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(bags, pa.binary())], ["label", "bag"])

    bags = written(text_rows(docs, id_col, text_col).join(sample, "doc_id").select("doc_id", "text", "label").mapInArrow(encode, "label int, bag binary"), "bags")
    return fit(bags, total)


def bags_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passages of some bags one after another, where each begins, labels) from rows (label, bag)."""
    some, marks = [], []
    for b in batches:
        for y, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            some.append(np.frombuffer(raw, np.float16).reshape(-1, FEATURES))
            marks.append(y)
            if sum(map(len, some)) >= AT_ONCE:
                yield np.concatenate(some).astype(np.float32), np.cumsum([0, *map(len, some[:-1])]), np.array(marks, np.float32)
                some, marks = [], []
    if some:
        yield np.concatenate(some).astype(np.float32), np.cumsum([0, *map(len, some[:-1])]), np.array(marks, np.float32)


def summed(bags: DataFrame, work) -> np.ndarray:
    """The sum over all bags of work(passages, starts, labels), a vector; a row for each task comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in bags_at_once(batches):
            one = np.asarray(work(*part), np.float64)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    rows = [np.frombuffer(bytes(r["v"]), np.float64) for r in bags.mapInArrow(sums, "v binary").collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(0)


def fit(bags: DataFrame, total: dict[int, int], steps: int = STEPS) -> Model:
    """Adam over the mean gradient of all bags (label, bag), summed by Spark in each step: neither the driver nor a task holds
    more than AT_ONCE passages and one document. `total`: how many documents have each label, which weighs the sample back."""
    spark, model = bags.sparkSession, Model()
    moments = summed(bags, lambda x, start, y: np.concatenate([[len(x), (y == 0).sum(), (y == 1).sum()], x.sum(0, dtype=np.float64), np.square(x, dtype=np.float64).sum(0)]))
    seen = moments[1:3] if len(moments) else np.zeros(2)
    if not seen.all():
        model.p["c"][:] = 0
        model.p["d"][:] = -3.0 if seen[0] else 3.0
        return model
    mean, square = moments[3 : 3 + FEATURES] / moments[0], moments[3 + FEATURES :] / moments[0]
    model.mean, model.scale = mean.astype(np.float32), (np.sqrt(np.maximum(0, square - mean * mean)) + 0.02).astype(np.float32)
    weight = np.array([total[y] / seen[y] for y in (0, 1)])
    weight = (weight / (weight @ seen)).astype(np.float32)  # they add up to 1
    state = [np.zeros(sum(v.size for v in model.p.values())) for _ in range(2)]
    for k in range(steps):
        sent = spark.sparkContext.broadcast(model)
        model.step(k, steps, summed(bags, lambda x, start, y, sent=sent: sent.value.flat(sent.value.gradient(x, start, y, weight[y.astype(int)]))), state)
        sent.unpersist()
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row; null texts are empty, null ids stay, repeated rows are returned each time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = text_rows(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. Rows are judged where they
    are, without a join, so that null or repeated ids make no difference."""
    columns = docs.columns
    at = columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = model.score([t or "" for t in b.column(at).to_pylist()]) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; an empty table gives an empty result."""
    out = scores(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
