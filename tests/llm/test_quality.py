"""Base measures and verdicts against plain Python on odd rows; the order of rules changes no verdict."""
import re
from collections import Counter

from gridlake.llm import quality

WORDS = " ".join(f"w{k}x" for k in range(60))
TEXTS = [None, "", " \t\n", "a", "a b c a b c a b c", "x\nx\n\nx\n y", WORDS, WORDS + " # $ | <>", "\n".join([WORDS] * 3), "éß " * 70, ("w ü " * 30000),
         WORDS.upper(), WORDS + "!!" * 40, "1 2 3 " * 30 + WORDS, "a b " * 60]


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    count = Counter(windows)
    hit = {p for k, x in enumerate(windows) if count[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_measures_and_verdicts(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(TEXTS)] + [(6, WORDS, "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, kept boolean")
    got = quality.quality_cascade(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = got.collect()
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in found) == sorted((i, *brute(t)) for i, t, _, _ in rows)
    kept = sorted(r["doc_id"] for r in found if r["kept"])
    assert kept.count(6) == 2 and not {0, 1, 2, 3, 4, 8, 11, 12} & set(kept)
    backwards = quality.quality_cascade(docs, rules=tuple(reversed(quality.RULES)), sample_rows=1)
    assert sorted(r["doc_id"] for r in backwards.filter("kept").collect()) == kept
    assert quality.quality_cascade(docs.limit(0)).count() == 0
