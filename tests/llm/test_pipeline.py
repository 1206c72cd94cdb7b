"""The pipeline's stages over a small corpus against what each must do."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm.queries import QUERIES

ITEM = "Then a train from Berlin to Paris carries one load of coal over the long old track while all the men wait for it."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    word = lambda syl: "".join(r.choice(syl) for _ in range(3))
    make = lambda syl, n: " ".join(word(syl) for _ in range(n))
    en, fr = ["the", "ing", "on", "er", "at"], ["qué", "eau", "oi", "ée", "le"]
    rows = [(i, make(en if i % 2 else fr, 80), ("fr", "en")[i % 2], "hot" if i % 3 else f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], "hot") for i in range(10)]  # exact copies
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], None) for i in range(10, 15)]  # near copies
    rows += [(300, "12 34 -- 56", "en", "hot"), (301, None, None, "hot"), (302, "", "en", "hot")]  # no language
    rows += [(400, make(en, 30) + " " + ITEM + " " + make(en, 30), "en", "s1"), (401, ITEM.replace("Berlin", "Madrid"), "en", "s2")]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(a, b, c, s, len(b or "")) for a, b, c, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, corpus), name)
        assert docs.columns == names
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    clean = [*range(60)]
    assert kept[0] == [*clean, *range(100, 110), *range(210, 215), 400, 401]
    assert kept[1] == [*clean, 400, 401]
    assert kept[2] == clean
    assert sorted(set(kept[3])) == clean and len(kept[3]) > len(clean)  # small sources are repeated, none is lost
    out = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).orderBy("start").collect()
    assert [r.doc_id for r in out] == kept[3]
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]


def test_run_and_registered_names(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).agg(F.countDistinct("doc_id")).first()[0] == 60
    assert sorted(QUERIES) == sorted(["op1_mix_sources", "op2_jaccard_join", "op3_secret_scan", "op4_language_id", "op5_quality", "op6_nearest_neighbours", "op7_main_text", "op8_decontaminate", "op9_remove_repeats", "op10_token_output", "op11_byte_bpe", "op12_phrases", "op13_hard_negatives"])
