"""Quality classifier: random-indexing word vectors pooled per document, and a small network.

Every word (a run of letters, of digits or of other signs) falls into one of VOCAB hash buckets and has a
fixed sparse index vector of a few +1 and -1. Its word vector is the sum of the index vectors of its
neighbours over all documents. A document is the mean of its words' unit vectors and of their squares,
the share of words whose vector equals the one before, and the logarithm of its length.
A two-layer network on these gives a logit; a temperature, fitted on labelled rows kept from training,
makes it a calibrated probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, held_out, prefix_hash, span_hash, staged, table, text_chunks

VOCAB, DIM, SIGNS = 1 << 14, 64, 4
#: Labelled rows learned from, at most: those of the smallest hashes of doc_id.
SAMPLE = 8192
HIDDEN, EPOCHS, RATE, DECAY = 32, 250, 0.01, 1e-4
THRESHOLD = 0.7
FEATURES = 2 * DIM + 2

# 0: white space, 1: letters (bytes of longer characters too), 2: digits, 3: other signs
_CLASS = np.full(256, 3, np.uint8)
_CLASS[IS_SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2

_rng = np.random.RandomState(7)
INDEX_AT = _rng.randint(0, DIM, (VOCAB, SIGNS))
INDEX_SIGN = np.where(np.arange(SIGNS) % 2, -1.0, 1.0)


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of each word, and the text that it is in."""
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    first[1:-1] |= kind[1:] != kind[:-1]
    edge = np.flatnonzero(first)
    start, end = edge[:-1], edge[1:]
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    word = span_hash(prefix_hash(data), start, end) & np.uint64(VOCAB - 1)
    return word.astype(np.int64), np.searchsorted(offs, start, "right") - 1


PART = 256  # buckets in a row of sums


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors, VOCAB x DIM, from all whole texts of docs.

    Each task adds up its own table; the tables' parts meet in tasks that add them as they stream in.
    The result's size is fixed, whatever the input.
    """
    kind = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def rows(total):
        parts = np.flatnonzero(np.abs(total).reshape(VOCAB // PART, -1).sum(1))
        for p in parts.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total[p * PART : (p + 1) * PART].astype("<f8").tobytes()], pa.binary())], schema=kind)

    def add(batches):
        total = np.zeros(VOCAB * DIM)
        for _, data, offs in text_chunks(batches):
            word, text = buckets(data, offs)
            near = text[1:] == text[:-1]
            left, right = word[:-1][near], word[1:][near]
            for a, b in ((left, right), (right, left)):
                for s in range(SIGNS):
                    total += np.bincount(a * DIM + INDEX_AT[b, s], minlength=VOCAB * DIM) * INDEX_SIGN[s]
        yield from rows(total.reshape(VOCAB, DIM))

    def meet(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[p] = held.get(p, 0) + np.frombuffer(body, "<f8").reshape(PART, DIM)
        for p, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sums.tobytes()], pa.binary())], schema=kind)

    spread = docs.select("text").mapInArrow(add, "part int, sums binary").repartition("part")
    out = np.zeros((VOCAB, DIM))
    for r in spread.mapInArrow(meet, "part int, sums binary").toLocalIterator():  # VOCAB / PART rows
        out[r["part"] * PART : (r["part"] + 1) * PART] += np.frombuffer(bytes(r["sums"]), "<f8").reshape(PART, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x): each document's features, FEATURES float32 as bytes; all 0 without a word. Null ids stay null;
    repeated rows give repeated results; very long texts are pooled whole."""

    def pool(batches):
        both = np.concatenate((vectors, vectors**2), 1)
        for rows, data, offs in text_chunks(batches):
            word, text = buckets(data, offs)
            n = len(offs) - 1
            x = np.zeros((n, FEATURES), np.float32)
            for lo in range(0, len(word), 1 << 15):
                t = text[lo : lo + (1 << 15)]
                at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                x[t[at], : 2 * DIM] += np.add.reduceat(both[word[lo : lo + (1 << 15)]], at, axis=0)
            count = np.bincount(text, minlength=n)
            x[:, : 2 * DIM] /= np.maximum(count, 1)[:, None]
            again = np.flatnonzero((word[1:] == word[:-1]) & (text[1:] == text[:-1]))
            x[:, -2] = np.bincount(text[again], minlength=n) / np.maximum(count, 1)
            x[:, -1] = np.log1p(count)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pool, "doc_id long, x binary")


class Network:
    """Standardised features -> tanh layer -> logit -> divided by a temperature -> probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.sd
        keep = rng.rand(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
        if len(set(y[~keep])) < 2 or len(set(y[keep])) < 2:
            keep[:] = False
        self.p = [rng.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        tx, ty = x[~keep], y[~keep]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(tx @ self.p[0] + self.p[1])
            d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - ty) / len(ty)
            back = np.outer(d, self.p[2]) * (1 - h * h)
            for i, g in enumerate((tx.T @ back + DECAY * self.p[0], back.sum(0), h.T @ d + DECAY * self.p[2], d.sum())):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if keep.any():
            z, t = self._logit(x[keep]), y[keep]
            loss = lambda c: np.logaddexp(0, -z / c * (2 * t - 1)).mean()
            self.temperature = float(min(np.exp(np.linspace(-2, 3, 101)), key=loss))

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.sd) / self.temperature, -700, 700)))


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Network | float:
    """A network from labelled rows: at most sample of them. With fewer than two classes: the share of label 1, smoothed."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    picked = rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id", "y").limit(sample)
    # Of documents that share a doc_id one teaches, that of the least features; so rows are as bounded as picked.
    got = features.join(F.broadcast(picked.distinct()), "doc_id").groupBy("h", "doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["h", "doc_id", "y"])
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    return Network(np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float), y)


def classify(features: DataFrame, net: Network | float) -> DataFrame:
    """(doc_id, score) for each row of features."""

    def score(batches):
        for batch in batches:
            x = np.stack([np.frombuffer(b, np.float32) for b in batch.column("x").to_pylist()]) if batch.num_rows else np.zeros((0, FEATURES))
            p = np.full(len(x), net) if isinstance(net, float) else net.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    features = staged(pooled(docs, word_vectors(docs)), "pooled")
    net = train(features, labels.filter(~held_out(F.col("doc_id"), 4, 2)))
    return classify(features, net).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
