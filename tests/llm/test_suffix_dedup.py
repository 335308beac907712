"""Removed bytes against brute force; merged order and common prefixes against sorting."""
import random
from collections import Counter

import numpy as np
import pytest

from gridlake.llm import suffix_dedup as sd


def brute(texts, length):
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone)))
    return out


def test_merge_order_and_common_prefixes():
    rng = random.Random(2)
    for n_runs in (1, 2, 3, 5, 8):
        pool = [(bytes(rng.choice(b"ab") for _ in range(rng.choice((3, 9, 9, 9)))), bytes(rng.choice(b"xy") for _ in range(2)), k, k) for k in range(80)]
        runs = [sd.Run(sd.front_coded(pool[k::n_runs])) for k in range(n_runs)]
        got = [(runs[r].suffix, known) for r, _, known in sd.merged(runs)]
        assert [g[0] for g in got] == sorted(g[0] for g in got)
        for (a, _), (b, known) in zip([(b"", 0), *got], got):
            assert known == sd.common_prefix(a, b, 0)


def local(texts, length, gram, n_runs):
    suffixes = [[] for _ in range(n_runs)]
    for key, t in enumerate(texts):
        for p in sd.anchors(t, length, gram)[0].tolist():
            suffixes[key % n_runs].append((t[p:p + length], t[max(0, p - length + gram):p][::-1], key, p))
    ranges = {k: [] for k in range(len(texts))}
    for k, a, b in zip(*sd.merge_group([sd.front_coded(s) for s in suffixes], length, gram)):
        ranges[int(k)].append((int(a), int(b)))
    return [sd.kept_bytes(t, ranges[k]) for k, t in enumerate(texts)]


@pytest.mark.parametrize("length,gram", [(12, 4), (20, 3), (9, 9), (30, 10)])
def test_removed_bytes_equal_brute_force(length, gram):
    rng = random.Random(length)
    for turn in range(60):
        alphabet = rng.choice((b"a", b"ab", b"abcdefgh", bytes(range(97, 123))))
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(6)]
        texts = [b"".join(rng.choice(parts)[rng.randrange(3):] if rng.random() < .6 else bytes(rng.choice(alphabet) for _ in range(rng.randrange(40)))
                          for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 12))]
        got = local(texts, length, gram, rng.choice((1, 2, 4)))
        assert [(rest, sum(b - a for a, b in spans)) for rest, spans in got] == brute(texts, length)


def test_anchors_cover_every_window_alike():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 4, 3000).astype(np.uint8).tobytes()
    places = sd.anchors(t, 30, 8)[0]
    assert all(((places >= k) & (places <= k + 22)).any() for k in range(len(t) - 29))
    other = b"xyz" + t[500:900]
    inside = sd.anchors(other, 30, 8)[0] - 3 + 500
    assert set(places[(places >= 530) & (places <= 860)]) <= set(inside)


def test_spark_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(6))
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(80))] + ([rng.choice(passages)] if i % 2 else []) + [word() for _ in range(30)]), "x") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "ab" * 5000, "x"), (103, passages[0], "x"), (7, "again " + passages[1], "x"), (104, "same row " * 40, "x"), (104, "same row " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    got = sorted((r["doc_id"], r["text"] or "", r["n_bytes"], bytes(r["kept"]), sum(s["end"] - s["begin"] for s in r["removed"])) for r in sd.deduplicated(docs).collect())
    datas = [(t or "").encode() for _, t, _ in rows]
    want = sorted((i, t or "", len(d), k, n) for (i, t, _), d, (k, n) in zip(rows, datas, brute(datas, 200)))
    assert got == want and sum(w[4] for w in want) > 5000
    assert sd.deduplicated(docs.limit(0)).count() == 0
