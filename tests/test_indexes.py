"""Stored indexes against scans of everything."""

import math
import random
from collections import Counter

from feedlake.operators import textindex
from feedlake.storage import new_path


def test_text_index_takes_segments_and_prunes_exactly(spark, monkeypatch):
    monkeypatch.setattr(textindex, "GROUP", 4)
    monkeypatch.setattr(textindex, "FIRST", 2)
    rnd = random.Random(2)
    common, rare = ["the", "of", "and"], [f"r{i}" for i in range(20)]
    texts = {i: " ".join([*rnd.choices(common, k=rnd.randint(1, 12)), *rnd.choices(rare, k=rnd.randint(0, 3))]) for i in range(200)}
    texts |= {300: "", 301: "The THE, the!", 302: "ünï r1 r1"}
    queries = {1: "the r1", 2: "of r7 R7 r8 and", 3: "nowhere", 4: "the and", 5: "", 6: "r1 ÜNÏ"}
    root = new_path(spark, "index")
    textindex.init(spark, root)
    ids = sorted(texts)
    for part in (ids[:120], ids[100:150], ids[150:]):  # some come twice
        textindex.add(spark.createDataFrame([(i, texts[i]) for i in part] + [(None, "the")], "doc_id long, text string"), root)
    found, work = textindex.search(spark.createDataFrame(list(queries.items()), "query_id long, text string"), root)
    tokens = {i: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for i, t in texts.items()}
    df = Counter(w for ws in tokens.values() for w in set(ws))
    average = sum(map(len, tokens.values())) / len(tokens)

    def score(q, ws):
        c = Counter(ws)
        idf = lambda w: math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5))
        return sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in set(q.lower().split()) if c[w])

    want = []
    for q, t in queries.items():
        hits = sorted((-round(s, 6), i) for i, ws in tokens.items() if (s := score(t, ws)) > 0)[:5]
        want += [(q, p, i, round(-s, 4)) for p, (s, i) in enumerate(hits, 1)]
    got = sorted((r.query_id, r.place, r.doc_id, round(r.score, 4)) for r in found.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-4 for g, w in zip(got, want, strict=True))
    read, every = Counter(r.query_id for r in work.collect()), len({(i // 4, 0 if i < 120 else 1 if i < 150 else 2) for i in ids})
    assert read[6] < every / 2, (read, every)  # groups of the rare words, not all of the frequent ones' lists


def test_vector_index_recall_against_the_exact_search(spark, sf, monkeypatch):
    import numpy as np

    from feedlake.operators import vectorindex
    from feedlake.plans import extensions

    # The given vectors, against the exact query.
    exact = {(r.query_id, r.vec_id) for r in extensions.ext_vector_top_k(spark, sf).collect()}
    got = {(r.query_id, r.vec_id) for r in extensions.ext_vector_index(spark, sf).collect()}
    assert len(got) == len(exact) and len(exact & got) >= 0.9 * len(exact)
    # Vectors around many centres, a third of them copies of one; blocks of a cell.
    monkeypatch.setattr(vectorindex, "BLOCK", 64)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    v = np.concatenate((middle[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 16)), np.repeat(middle[:1], 700, 0)))
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16), (9004, [1.0, 2.0]), (9005, [1e300] * 16)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, v array<double>")
    root = new_path(spark, "vectors")
    vectorindex.build(rows, root)
    found = vectorindex.search(rows.filter("vec_id % 20 = 0"), root, 5).collect()
    u = np.concatenate((v, np.ones((1, 16))))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    good = total = 0
    for q in range(0, 2200, 20):
        own = [r for r in found if r.query_id == q]
        best = np.sort(np.delete(score[q], q))[::-1][:5]
        assert [r.place for r in sorted(own, key=lambda r: r.place)] == [1, 2, 3, 4, 5]
        good += sum(r.score >= best[4] - 1e-6 for r in own)
        total += 5
    assert good >= 0.9 * total
    assert vectorindex.search(rows.filter("false"), root).count() == 0
    empty = new_path(spark, "vectors")
    vectorindex.build(rows.filter("vec_id = 9001"), empty)
    assert vectorindex.search(rows.limit(5), empty).count() == 0


def test_vector_index_reads_its_vectors_once_and_ranks_copies_by_id(spark, monkeypatch):
    """The given vectors pass through the index's build once, and a search of all cells is the exact one, ties included."""
    import numpy as np

    from feedlake.operators import vectorindex

    monkeypatch.setattr(vectorindex, "BLOCK", 16)
    monkeypatch.setattr(vectorindex, "ASKED", 8)
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, size=(400, 6)).astype(float)
    v[100:250] = v[7]  # copies, in several blocks of a cell
    v[300] = 0
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    root = new_path(spark, "vectors")
    vectorindex.build(rows.mapInArrow(counted, rows.schema), root, cells=4)
    assert passed.value == 400
    found = vectorindex.search(rows.filter("vec_id % 10 = 0"), root, 5, probes=4).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    score = np.round(u @ u.T, 10)
    want = []
    for q in range(0, 400, 10):
        best = sorted((-score[q, c], c) for c in range(400) if c not in (q, 300))[:5]
        want += [(q, place, c) for place, (_, c) in enumerate(best, 1) if q != 300]
    assert sorted((r.query_id, r.place, r.vec_id) for r in found) == want


def test_vector_top_k_equals_sql_on_odd_vectors(spark, tmp_path, monkeypatch):
    """Null, zero and infinite vectors, copies, null and repeated ids, in several blocks and groups of queries."""
    import duckdb

    from feedlake.operators import nearest
    from feedlake.plans import extensions

    for name, value in (("BLOCK", 32), ("QUERIES", 4), ("SLICE", 2)):
        monkeypatch.setattr(nearest, name, value)
    rnd = random.Random(8)
    v = {i: [float(rnd.randint(-2, 2)) for _ in range(5)] for i in range(1200)}
    v |= {i: v[7] for i in range(200, 420)} | {3: None, 100: None, 9: [0.0] * 5, 300: [0.0] * 5, 11: [float("inf"), 1.0, 0.0, 0.0, 0.0], 500: []}
    rows = [*v.items(), (None, v[1]), (700, v[8]), (8, v[8]), (8, v[13])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = extensions.ext_vector_top_k(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    # The SQL's function takes lists of one length; an empty list's score is null, as a null one's.
    c.execute(f"create view embeddings as select vec_id, nullif(embedding, []) as embedding from '{tmp_path}/embeddings.parquet/*.parquet'")
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert plain(found) == plain(c.execute(extensions.EXT_VECTOR_TOP_K).fetchall())
