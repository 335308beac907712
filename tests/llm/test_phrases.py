"""Collocations against counting in plain Python."""
import random
import re
from collections import Counter, defaultdict

import pytest

from gridlake.llm import phrases


def brute(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in some.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= some.get(p[i:i + k], a + 1)}
        found = []
        for p, a in some.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["the", "New", "york", "é", "of", "a", "x\x00y", "\xa0", "zz", "I'm", "漢字"]
    rows = [(" ".join(rng.choice(words[:rng.randrange(2, len(words))]) + rng.choice(["", "", "", ",", ".", "\t", "\n", "\x0b", " "])
                      for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    return rows + [(None, "en"), ("", "de"), (" ,. ", None), ("only once here", "es"), ("A b c d e f. " * 40, "en"), ("a b c d e f " * 40, "fr")] + [("same text twice", "en")] * 30


@pytest.mark.parametrize("block, least, longest, top", [(phrases.BLOCK, 20, 5, 2000), (50, 20, 5, 7), (400, 5, 3, 2000), (50, 10 ** 6, 5, 5)])
def test_equals_plain_counting(spark, block, least, longest, top):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, x, 0, "w") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, block int, word string")
    got = sorted(map(tuple, phrases.collocations(docs.repartition(5), least, longest, top, block, part_bytes=300).collect()))
    assert got == brute(rows, least, longest, top)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    big = [(3 * 10 ** 13 + 7, 9 * 10 ** 14 + 1, 10 ** 14 + 9, 7 * 10 ** 13 + 3), (2, 3, 1, 1), (10 ** 15, 8 * 10 ** 15, 10 ** 15 + 1, 10 ** 15 + 3)]
    df = spark.createDataFrame([(a, n, [l], [r]) for a, n, l, r in big], "a long, n long, heads array<long>, tails array<long>")
    got = [r["score"] for r in df.withColumn("cut", phrases._cut(2)).select(F.col("cut.score")).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in big]
