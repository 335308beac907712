"""Components against all pairs, the prefix filter's completeness, hot groups."""
import random
import re

import numpy as np

from gridlake.llm import jaccard


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                comp[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n_words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(400)]
    rows, i = [], 0
    line = " ".join(rng.choice(vocabulary) for _ in range(14))
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, n_words))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy) + (f"\n{line}" if rng.random() < .4 else ""), "x"))
            i += 1
    for t in (None, "", " \t", "One", "one", "a b c d", "A b c d", "a b c d e", "a b c d e f", "line " * 300, "Line " * 200):
        rows.append((i, t, "x"))
        i += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark):
    for seed, frequent, rounds in ((1, 64, 3), (2, 1, 1), (3, 3, 0)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, rep string").repartition(4)
        got = sorted(map(tuple, jaccard.similarity_components(docs, frequent=frequent, leader_rounds=rounds).collect()))
        assert got == brute(rows), (seed, [x for x in zip(got, brute(rows)) if x[0] != x[1]][:5])


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (3, "a b c d e f", 1), (1, "A b c d e f", 1)], "doc_id long, text string, n long")
    assert sorted(map(tuple, jaccard.similarity_components(docs).collect())) == [(1, 2, 1), (3, 2, 1), (3, 2, 1)]
    assert jaccard.similarity_components(docs.limit(0)).count() == 0


def _meet(x, y, hot):
    (a, one_x, hot_x), (b, one_y, hot_y) = jaccard.signatures(x, hot, None), jaccard.signatures(y, hot, None)
    n, m = len(x), len(y)
    k = jaccard.groups_of(jaccard.size_class(min(n, m))) + 1
    overlap = -(-80 * (n + m) // 180)
    need = min(jaccard.prefix_length(s, k) - (s - overlap) for s in (n, m)) - min(hot_x, hot_y)
    return np.intersect1d(a, b).size >= max(1, need) and need <= min(one_x, one_y)


def test_similar_sets_share_a_signature():
    """For any share of frequent tokens, two sets at the threshold meet in a bucket."""
    rng = np.random.default_rng(7)
    for share in (0.0, 0.3, 0.9, 1.0):
        for size in (4, 5, 9, 16, 31, 32, 33, 100, 260, 1000):
            for _ in range(6):
                tokens = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
                small = tokens[:size]
                extra = size // 4 if rng.random() < .5 else 0       # a superset, or as many tokens exchanged as allowed
                if extra or size < 9:
                    other = tokens[:size + max(extra, size // 4)]
                else:
                    swapped = size // 9
                    other = tokens[swapped:size + swapped]
                x, y = np.unique(small), np.unique(other)
                if not jaccard.similar(x, y):
                    continue
                bits = np.zeros(jaccard.FREQUENT_BITS // 64, np.uint64)
                for t in tokens[rng.random(2 * size) < share]:
                    for at in (int(t) & (jaccard.FREQUENT_BITS - 1), int(t) >> 32 & (jaccard.FREQUENT_BITS - 1)):
                        bits[at >> 6] |= np.uint64(1 << (at & 63))
                hot = jaccard.Filter(bits)
                assert _meet(x, y, hot), (share, size)


def test_sketches_part_the_unlike_and_never_the_similar():
    """What a bucket of near copies gives out must not grow with all its pairs."""
    rng = np.random.default_rng(11)
    kept = {0.6: 0, 0.8: 0}
    for share in kept:
        for size in (40, 146, 400):
            for _ in range(50):
                tokens = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
                both = -int(-2 * size * share // (1 + share))
                x, y = np.unique(tokens[:size]), np.unique(tokens[size - both:2 * size - both])
                apart = int(np.bitwise_count((jaccard.sketch(x) ^ jaccard.sketch(y)).view("<u8")).sum())
                assert apart <= len(np.setxor1d(x, y))
                kept[share] += apart <= 2 * size - 2 * -(-80 * 2 * size // 180)
    assert kept[0.8] == 150 and kept[0.6] < 20, kept


def test_sketches_part_longer_texts():
    rng = np.random.default_rng(13)
    for _ in range(50):
        tokens = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
        x, y = np.unique(tokens[:600]), np.unique(tokens[150:750])
        apart = int(np.bitwise_count((jaccard.sketch(x) ^ jaccard.sketch(y)).view("<u8")).sum())
        assert 132 < apart <= len(np.setxor1d(x, y))


def test_signatures_in_the_same_sets_make_one_bucket(spark, monkeypatch):
    """Three near copies share many signatures, but there are only four sets of two or three of them."""
    made, stored = [], jaccard.stored

    def keep(df, name):
        made.append((name, stored(df, name)))
        return made[-1][1]

    monkeypatch.setattr(jaccard, "stored", keep)
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(d, " ".join(words[:50 * d] + [f"own{d}"] + words[50 * d:])) for d in (1, 2, 3)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.similarity_components(docs).orderBy("doc_id").collect()] == [(d, 197, 1) for d in (1, 2, 3)]
    first = next(df for name, df in made if name == "buckets")
    assert first.count() <= 9 and first.agg({"weight": "max"}).first()[0] > 9
