"""Counts and baseline against plain Python; predictive probabilities sum to one; held-out gain."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import pitman_yor as py
from gridlake.llm import shared


def held(i, mod=10):
    return zlib.crc32(str(i).encode()) % mod == 0


def held_column():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def test_packed_round_trip():
    for a in (np.empty(0, np.uint32), np.arange(5, dtype=np.uint64), np.array([1.5, -2], np.float32)):
        assert (py.unpacked(py.packed(a)) == a).all() and py.unpacked(py.packed(a)).dtype == a.dtype


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(0, 1 << 56, 50, dtype=np.uint64))
    w = np.repeat(words, 8)
    u = np.tile(np.arange(8), 50).astype(np.uint16)
    c = rng.integers(0, 6, 400) ** 4
    seat = lambda: py.Seating(w[c > 0], u[c > 0], c[c > 0], 8, 3)
    history = [py.totals_of(seat().figures(), 8)]
    for _ in range(3):
        own = seat()
        for number, before in enumerate(history, 1):
            own.sweep(number, before)
        assert (own.t <= own.c).all() and (own.t >= 1).all() and (own.root_t <= own.root_customers()).all()
        history.append(py.totals_of(own.figures(), 8, history[0].discounts))
    unknown = np.uint64(12345)
    assert unknown not in words
    for context in range(8):
        asked = np.sort(np.concatenate([words, [unknown]]))
        p, counts = next(py.answers(seat(), history, [(asked, np.full(51, context, np.uint16), None)], 1))
        assert sum(10.0 ** p.astype(float)) == pytest.approx(1, abs=1e-5)
        assert counts.sum() == c.sum()


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(5)
    n, d, pull = 20, 0.4, 0.7
    got = py.Seating.seat(np.full(20000, n), np.full(20000, pull), d, rng).mean()
    law = np.zeros(n + 1)
    law[1] = 1
    for i in range(1, n):
        new = np.zeros(n + 1)
        for t in range(1, n):
            p = pull / (pull + i - d * t)
            new[t] += law[t] * (1 - p)
            new[t + 1] += law[t] * p
        law = new
    assert abs(got - (law * np.arange(n + 1)).sum()) < 0.05


def test_scores(spark):
    rows = [(r["doc_id"], r["text"], 1.0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, "The THE ünï " * 3000, 1.0), (7, "twice", 1.0), (7, "twice", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    got = py.scored(docs, held_column(), block_bytes=30_000, group_bytes=100_000).collect()
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[(i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(base, 5))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    again = py.scored(docs, held_column(), block_bytes=60_000, group_bytes=100_000).agg(F.sum("score")).first()[0]
    assert again == pytest.approx(sum(r["score"] for r in got), rel=1e-6)
    assert py.scored(docs.limit(0), held_column()).count() == 0
    none = py.scored(docs.limit(3), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)


def test_every_preceding_word_is_a_context_of_its_own(spark):
    texts = [f"w{i} v{i}" for i in range(1000)]
    words, context, doc = py.token_stream(texts)
    assert len(set(context.tolist())) == 2001 and (context[1:] == words[:-1]).all() and context[0] == py.END
    # each of 1,000 words has one successor: with a few hundred contexts many would share a restaurant
    docs = spark.createDataFrame([(i, f"{t} " * 5) for i, t in enumerate(texts * 2)], "doc_id long, text string").repartition(4)
    got = py.scored(docs, F.col("doc_id") >= 1000, block_bytes=5_000, group_bytes=5_000).filter("held_out").agg(F.sum("score"), F.sum("n_tokens"), F.count("*")).first()
    assert got[2] == 1000 and got[0] / got[1] > -0.75


def test_words_of_many_texts_in_slices():
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"%d" % x for x in rng.integers(0, 99, n)) for n in (0, 5, 0, 90, 3, 40, 1)]
    want = [shared.joined_words([t])[0].tolist() for t in texts]
    for size in (1, 64, 1 << 20):
        before, shared.SLICE = shared.SLICE, size
        hashes, bounds = shared.joined_words(texts)
        shared.SLICE = before
        assert [hashes[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert shared.joined_words([])[1].tolist() == [0]
