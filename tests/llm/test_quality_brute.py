"""Word vectors, pooling, network and temperature against slow versions."""

import math
import random

import numpy as np
import regex

from feedlake.llm import quality


def words_of(text):
    return regex.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t\n\x0b\x0c\r]+", text.encode())


def bucket(word):
    found = quality.buckets(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]
    assert len(found) == 1
    return int(found[0])


def slow_vectors(texts):
    out = np.zeros((quality.VOCAB, quality.DIM))
    for t in texts:
        ids = [bucket(w) for w in words_of(t)]
        for a, b in zip(ids, ids[1:], strict=False):
            for x, y in ((a, b), (b, a)):
                for s in range(quality.SIGNS):
                    out[x, quality.INDEX_AT[y, s]] += quality.INDEX_SIGN[s]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def slow_features(text, vectors):
    ids = [bucket(w) for w in words_of(text)]
    if not ids:
        return np.zeros(quality.FEATURES)
    mean = sum(vectors[i] for i in ids) / len(ids)
    square = sum(vectors[i] ** 2 for i in ids) / len(ids)
    again = sum(a == b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    return np.concatenate((mean, square, [again, math.log1p(len(ids))]))


def test_vectors_and_pooling(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["river", "boat", "ñu", "12", "a-b", "the", "the", "x9", "...", "日本"]) for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    texts += ["", "one", "word word word", "tab\tline\nend", "y" * 5000, "long " * 20_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])], "doc_id long, text string").repartition(3)
    vectors = quality.word_vectors(docs)
    want = slow_vectors([*texts, texts[3]])
    assert np.abs(vectors - want).max() < 1e-6
    rows = quality.pooled(docs, vectors).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "" if r.doc_id is None else texts[r.doc_id]
        assert np.abs(np.frombuffer(r.x, np.float32) - slow_features(text, want)).max() < 1e-4


def test_network_and_temperature():
    rng = np.random.RandomState(3)
    x = rng.randn(400, 6)
    y = (x[:, 0] * x[:, 1] + 0.7 * rng.randn(400) > 0).astype(float)
    net = quality.Network(x, y)
    sharp = quality.Network.__new__(quality.Network)
    sharp.mean, sharp.sd, sharp.p = net.mean, net.sd, net.p

    def slow(row, temperature):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.sd, strict=True)]
        hidden = [math.tanh(sum(z[i] * net.p[0][i][j] for i in range(len(z))) + net.p[1][j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + float(net.p[3])
        return 1 / (1 + math.exp(-logit / temperature))

    got = net.score(x[:20])
    assert max(abs(slow(r, net.temperature) - p) for r, p in zip(x[:20], got, strict=True)) < 1e-9
    assert np.mean((net.score(x) >= 0.5) == y) > 0.8
    # The temperature is the best of its grid on the fifth that was kept from learning.
    rng = np.random.RandomState(1)
    keep = rng.rand(len(y)) < 0.2

    def loss(c):
        p = np.array([slow(r, c) for r in x[keep]])
        return -np.mean(y[keep] * np.log(p) + (1 - y[keep]) * np.log(1 - p))

    best = loss(net.temperature)
    assert all(best <= loss(c) + 1e-9 for c in np.exp(np.linspace(-1, 3, 21)))
    # Scores keep their order whatever the temperature, and equal rows have equal scores.
    sharp.temperature = 1.0
    assert (np.argsort(sharp.score(x), kind="stable") == np.argsort(net.score(x), kind="stable")).all()
    assert np.ptp(net.score(np.repeat(x[:1], 5, 0))) == 0
