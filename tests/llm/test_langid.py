"""Viterbi against brute force, spans of mixed text, held-out accuracy."""
import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridlake.llm import langid


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for steps, k in ((1, 3), (4, 2), (5, 3)):
        scores = rng.normal(0, 2, (4, steps, k)).astype(np.float32)
        got = langid.viterbi(scores, 1.5)
        for row in range(4):
            value = lambda p: sum(scores[row, t, x] for t, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            best = max(map(value, itertools.product(range(k), repeat=steps)))
            assert abs(value(got[row]) - best) < 1e-4


def corpus(spark):
    ru, en = "привет мир это слова русского языка ", "hello world these words are english text "
    rows = [(i, (ru if i % 2 else en) * 3, "ru" if i % 2 else "en", 0.5) for i in range(40)]
    return spark.createDataFrame(rows + [(100, None, "en", 1.0), (101, "x", None, 1.0)], "doc_id long, text string, lang string, score double")


def test_mixed_text_and_odd_rows(spark):
    docs = corpus(spark)
    model = langid.train(docs)
    assert model.languages == ["en", "ru"]
    mixed = "hello world these words 12 привет мир это слова"
    odd = spark.createDataFrame([(1, mixed, "y"), (2, None, "y"), (3, "", "y"), (4, "12 .. 9", "y"), (5, "hello " * 40000, "y"), (5, "hello " * 40000, "y"), (6, "İİ hello", "y")],
                                "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in langid.identified(odd, model).collect()}
    spans = [(s["begin"], s["end"], s["lang"]) for s in got[1]["spans"]]
    assert spans == [(0, 23, "en"), (27, 47, "ru")] and got[1]["lang_pred"] == "en" and 0.5 < got[1]["score"] < 0.6
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, []) for i in (2, 3, 4))
    assert got[5]["lang_pred"] == "en" and got[5]["score"] == 1.0 and len(got[5]["spans"]) == 1 and got[6]["lang_pred"] == "en"
    assert langid.identified(odd, model).count() == 7 and langid.identified(odd.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identified(odd, nothing).collect()} == {"und"}


def test_training_sample_is_bounded(spark):
    model = langid.train(corpus(spark), max_docs=5)
    assert model.languages == ["en", "ru"] and np.isfinite(model.weights).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = langid.identified(docs, model).withColumn("held", langid.held_out()).select("doc_id", "lang", "lang_pred", "held").collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    known = [r for r in rows if r["held"] and r["lang"]]
    assert len(known) > 150 and sum(r["lang"] == r["lang_pred"] for r in known) >= 0.98 * len(known)
