"""Byte-level BPE against its library and plain merging, phrases and hard negatives against brute force."""

import hashlib
import itertools
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlake.llm import bytebpe, hardneg, phrases

sys.path.insert(0, "/opt")
tokenizers = pytest.importorskip("public_tokenizers", reason="no vocabularies here") if __import__("importlib").util.find_spec("public_tokenizers") else None
needs_files = pytest.mark.skipif(tokenizers is None, reason="no vocabularies here")
DOCS = "doc_id long, text string, lang string, TEXT_ string, ids string"


def merged(ranks: dict, piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def small_vocabulary(seed: int, size: int) -> list[bytes]:
    """Tokens as training would make them: each the merge of two earlier ones that meet in some text."""
    rnd = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    text = [bytes([rnd.choice(b"abc ")]) for _ in range(600)]
    while len(tokens) < 256 + size:
        (a, b), n = Counter(itertools.pairwise(text)).most_common(1)[0]
        if n < 2:
            break
        tokens.append(a + b)
        out = []
        for t in text:
            if out and out[-1] == a and t == b:
                out[-1] = a + b
            else:
                out.append(t)
        text = out
    return tokens


@pytest.mark.parametrize("seed", range(6))
def test_backtracking_is_merging(seed):
    tokens = small_vocabulary(seed, 80)
    ranks, words, rnd = {t: i for i, t in enumerate(tokens)}, bytebpe.Vocabulary(tokens), random.Random(seed)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abc d") for _ in range(rnd.randint(1, 60)))
        assert words.encode(piece) == merged(ranks, piece)


def test_a_vocabulary_that_is_no_training_result_is_refused():
    with pytest.raises(ValueError):
        bytebpe.Vocabulary([bytes([b]) for b in range(256)] + [b"abc"])


@needs_files
def test_byte_bpe_equals_its_library(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bytebpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rnd = random.Random(5)
    made = ["".join(tokens[rnd.randrange(len(tokens))].decode(errors="replace") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    made += ["", " ", "\n\n  x", "don't I'LL 're", "<|endoftext|>", "\U0001df67a \U0002cea7a", "é​ ", "0x1F 12345678901", "y" * 70_000, " " * 30_000, "ab" * 600_000, *made[:3]]
    rows = [(i, t, "x", "other", "clash") for i, t in enumerate(made)] + [(None, None, None, None, None)]
    out = bytebpe.decode(bytebpe.encode(spark.createDataFrame(rows, DOCS), path, tokenizers.PATTERN), path).collect()
    assert len(out) == len(rows)
    for r in out:
        text = made[r.doc_id] if r.doc_id is not None else ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bytebpe.encode(spark.createDataFrame([], DOCS), path, tokenizers.PATTERN).count() == 0
    few = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    ids = {r.doc_id: r.i for r in bytebpe.encode(few, path, tokenizers.PATTERN).select("doc_id", bytebpe.ids_array(F.col("ids")).alias("i")).collect()}
    assert ids == {1: enc.encode_ordinary("some words"), 2: []}


@needs_files
def test_op11(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bytebpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    found = {r.doc_id: r for r in bytebpe.op11_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids, text = enc.encode_ordinary(d.text or ""), (d.text or "").encode()
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())


def slow_phrases(rows, least, longest, top):
    words, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[lang] += len(ws)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    held = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    out = {}
    for (lang, p), a in cand.items():
        if any(l2 == lang and len(q) > len(p) and held(p, q) and 100 * b >= 100 * a for (l2, q), b in cand.items()):
            continue
        n = words[lang]
        cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, rows in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_phrases_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD_PRINTS", held)
    monkeypatch.setattr(phrases, "HELD_PHRASES", held)
    rnd = random.Random(3)
    vocabulary = ["a", "b", "C", "ñu", "日本", "d'e", "x y", "w" * 80]
    line = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "\t", "  ", ". ", "\n", "\x0b", "!?"]) for _ in range(rnd.randint(0, 30)))
    rows = [(rnd.choice(["en", "de", None, "und"]), line()) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, "..!"), ("en", "one two three four five six " * 4000)] + [("xx", "same words here now today again")] * 7 + [("yy", "only once")]
    df = spark.createDataFrame([(lang, t, i, "x") for i, (lang, t) in enumerate(rows)], "lang string, text string, n long, WORDS string").repartition(3)
    found = phrases.collocations(df, 7, 5, 40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == slow_phrases(rows, 7, 5, 40)
    assert phrases.collocations(df.limit(0), 7, 5, 40).count() == 0


def test_phrases_that_share_a_fingerprint(spark, monkeypatch):
    """With two fingerprints in all, counts stay those of the text."""
    real = phrases.mix64
    monkeypatch.setattr(phrases, "mix64", lambda h: real(h) & phrases.U64(1))
    rows = [("en", "a b c. a b d. c a b")] * 9 + [("de", "b c a d")] * 8
    cut = phrases.chunks(spark.createDataFrame(rows, "lang string, text string"))
    counts = Counter()

    class All:
        value = type("B", (), {"has": staticmethod(lambda h: np.ones(len(h), bool))})

    batches = cut.select("lang", "ids", "words").toArrow().to_batches()
    for batch in batches:
        for c in phrases.opened(batch):
            for n in (1, 2):
                assert set(c.prints(n)[1].tolist()) <= {0, 1}
    for r in phrases._verified(cut, [All] * 3).collect():
        counts[r.lang, bytes(r.phrase).decode()] += r.n
    assert counts["en", "a b"] == 27 and counts["en", "a b c"] == 9 and counts["de", "c a d"] == 8 and counts["en", "c a b"] == 9


def test_only_words_are_read_again(spark, monkeypatch):
    """The verifying pass sends words, no phrases: its rows don't grow with the phrases that pass the bound."""
    real, sent = phrases._verified, []
    monkeypatch.setattr(phrases, "_verified", lambda *a: sent.append(real(*a)) or sent[-1])
    df = spark.createDataFrame([("en", "a b c d e. a b")] * 30, "lang string, text string").repartition(3)
    found, _ = phrases.phrase_counts(df, 7, 5)
    assert {(r.phrase, r.n) for r in found.filter("words > 3").collect()} == {("a b c d", 30), ("b c d e", 30), ("a b c d e", 30)}
    assert [r.words for r in sent[0].select("words").distinct().collect()] == [1] and len(sent) == 1


@pytest.mark.parametrize("held", [1 << 25, 20])
def test_rows_of_words_follow_the_text(spark, monkeypatch, held):
    """A task sends each of its distinct words, so words that get frequent in a larger text add no rows of their own."""
    monkeypatch.setattr(phrases, "HELD_BYTES", held)
    real, sent = phrases._verified, []
    monkeypatch.setattr(phrases, "_verified", lambda *a: sent.append(real(*a)) or sent[-1])
    text = ", ".join(f"w{i}" for i in range(60))
    for times in (1, 5):
        df = spark.createDataFrame([("en", text)] * times, "lang string, text string").repartition(times)
        found, _ = phrases.phrase_counts(df, 3, 2)
        assert sorted((r.phrase, r.n) for r in found.collect()) == sorted((f"w{i}", 5) for i in range(60) if times == 5)
    few, many = (x.count() for x in sent)
    assert 0 < many <= 5 * few


def test_rare_phrases_of_frequent_parts_are_not_sent(spark, monkeypatch):
    """Pairs of 12 words are frequent, most of their triples are not: these stay in their tasks."""
    real, sent = phrases._counted_keys, {}
    monkeypatch.setattr(phrases, "_counted_keys", lambda cut, n, *a: sent.setdefault(n, real(cut, n, *a)))
    rnd = random.Random(4)
    rows = [("en", "one two three. " + " ".join(rnd.choice("abcdefghijkl") for _ in range(900))) for _ in range(10)]
    found, _ = phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string").repartition(2), 10, 3)
    counts = Counter(tuple(ws[i : i + n]) for _, t in rows for piece in t.split(".") for ws in [piece.split()] for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    assert {r.phrase: r.n for r in found.collect()} == {" ".join(k): a for k, a in counts.items() if a >= 10}
    kept = sum(len(k) == 3 and a >= 10 for k, a in counts.items())
    assert sum(len(k) == 3 for k in counts) > 1000 and kept <= sent[3].count() < 2 * kept + 100


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_phrases_of_few_prints(spark, monkeypatch, held):
    """With eight fingerprints in all, so that buckets hold many phrases each, results are those of brute force."""
    real = phrases.mix64
    monkeypatch.setattr(phrases, "mix64", lambda h: real(h) & phrases.U64(7) | phrases.U64(1 << 17))
    monkeypatch.setattr(phrases, "HELD_PRINTS", held)
    rnd = random.Random(6)
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice(["a", "b", "c", "d.", "e"]) for _ in range(40))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in phrases.collocations(df, 12, 4, 50).collect()) == slow_phrases(rows, 12, 4, 50)


def test_phrases_of_one_print_in_a_task():
    keys = [np.array([1, 2, 1, 3]), np.array([5, 5, 5, 5])]
    _, (a, b), n = phrases._summed(np.array([7, 7, 7, 8]), keys, np.ones(4))
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(1, 5, 2), (2, 5, 1), (3, 5, 1)]


def test_words_of_one_hash_have_their_own_numbers(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_hashes", lambda words: np.zeros(len(words), phrases.U64))
    v = phrases.Vocabulary(spark.createDataFrame([("en", b"b", 9), ("en", b"a", 8), ("de", b"a", 7)], "lang string, phrase binary, n long"))
    assert v.numbers("en", pa.array([b"a", b"c", b"b"], pa.binary())).tolist() == [1, -1, 0]
    assert v.numbers("de", pa.array([b"b", b"a"], pa.binary())).tolist() == [-1, 2] and v.numbers("fr", pa.array([b"a"], pa.binary())).tolist() == [-1]


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    schema = "lang string, words int, phrase string, n long"
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)], schema)
    totals = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (found, totals))
    (r,) = phrases.collocations(found).collect()
    assert r.score == 1000 * (big - 7) * 9 * 10**14 // (big * (big + 1))


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (40, 65, 41), (129, 3, 200), (64, 64, 64), (100, 100, 37)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    m, d, n = shape
    a, b = rng.integers(-(2**25), 2**25, (m, d)), rng.integers(-(2**25), 2**25, (d, n))
    assert (hardneg.strassen(a, b) == a @ b).all()
    assert (hardneg.strassen(a.astype(object), b.astype(object)) == a @ b).all()


def slow_negatives(rows, positives, negatives, low, high):
    ok = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])
    rows = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in filter(ok, rows)]
    out = []
    for i, lab, v in rows:
        if i % 10:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))  # noqa: B023, E731
        all_ = sorted((-score(w), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        for s, p, _ in [x for x in all_ if x[2] == lab][:positives]:
            hits = [(t, j) for t, j, m in all_ if m != lab and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(hits, 1)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CANDIDATE_BLOCK", 70)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 9)
    rnd = random.Random(8)
    rows = [(i, rnd.randint(0, 3) if rnd.random() < 0.9 else None, [rnd.gauss(0.2, 1) for _ in range(20)]) for i in range(400)]
    rows += [(1000 + i, i % 2, [0.5] * 20) for i in range(60)]  # ties
    rows += [(2000, 1, None), (2010, 1, [None] + [1.0] * 19), (2020, 1, [float("nan")] * 20), (2030, 1, [float("inf")] * 20), (None, 1, [1.0] * 20), (2040, 2, [1.0, 2.0]), (2050, 2, []), (2060, 2, [0.0] * 20), (2070, 9, [1.0] * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, v array<double>, ID_ string").repartition(3)
    found = hardneg.hard_negatives(df, F.col("id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in found.collect()) == slow_negatives(rows, 5, 10, 30, 90)
    again = hardneg.hard_negatives(df.limit(0), F.col("id") % 10 == 0)
    assert again.count() == 0


def test_hard_negatives_of_large_numbers_and_repeats(spark):
    """Codes whose products pass 64 bits are exact where the scores fit; a repeated anchor counts once, candidates each."""
    rows = [(0, 1, [2.0**40, 1.0]), (0, 1, [2.0**40, 1.0]), (1, 1, [-1.0, 2.0**39]), (1, 1, [-1.0, 2.0**39]), (2, 2, [2.0**-1, 3.0]), (2, 2, [2.0**-1, 3.0]), (3, 1, [2.0**41, 5.0]), (4, 1, [2.0**-8, 1.0]), (5, 2, [2.0**-9, -(2.0**46)])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    found = hardneg.hard_negatives(df, F.col("id") == 0, 2, 10, -10**9, 10**9).orderBy("positive_id", "rank").collect()
    best = 2**48 * 1 + 256 * 256  # row 4; row 3 passes 64 bits, and a positive below 0 (row 1) opens no window
    assert [(r.positive_id, r.positive_score, r.negative_id, r.negative_score) for r in found] == [(4, best, 2, 2**48 * 128 + 256 * 768)] * 2 + [(4, best, 5, -256 * 2**54)]
