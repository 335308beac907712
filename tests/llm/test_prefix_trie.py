"""The prefix trie against a dictionary of all prefixes."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridlake.llm import prefix_trie as trie


def rebuilt(rows, family=20):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: tuple(t for _, t in sorted(x)) for c, x in own.items()}
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)        # the remainder has the sign of c
        out[c] = turns.get(base, ())[:h] + x[h:]
    return out


def brute(rows, family=20):
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in rebuilt(rows, family).items():
        ends[x].append(c)
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    below = {p: [0, 0, 0] for p in members}
    for p in sorted(members, key=len, reverse=True):
        kids, leaves, saved = below[p]
        below[p][1] = leaves = leaves if kids else 1
        below[p][2] = saved = saved + (len(members[p]) - 1) * (len(re.findall("[^ \t-\r]+", p[-1][1])) if p else 0)
        if p:
            for k, v in enumerate((1, leaves, saved)):
                below[p[:-1]][k] += v
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), *below[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                  for p, cs in members.items())


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, path string")
    got = trie.prefix_trie(df.repartition(4), **options).drop("key").collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in got)


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for turn in range(rng.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, rng.choice([None, 0, turn]) if seed else turn, rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "c", "", None, "é d\x0b漢 x"])))
    rows += [r for r in rows if rng.random() < 0.05] + [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(1000 + k, t, "user", "hot first turn" if t == 0 else f"{k}") for k in range(0, 200) for t in range(2)]
    rows += [(5000 + k, t, "user", f"copy {t}") for k in range(0, 150) for t in range(6)]
    return rows + [(9000 + 20 * k, t, "user", f"deep {t}") for k in range(2) for t in range(90 + k)]


@pytest.mark.parametrize("seed, block, block_turns, round_bits, chunk", [(0, 50_000, 10 ** 6, 4, 50_000), (1, 7, 10 ** 6, 1, 3), (2, 1, 10, 2, 1), (3, 40, 10 ** 6, 1, 10)])
def test_equals_a_dictionary_of_prefixes(spark, seed, block, block_turns, round_bits, chunk):
    rows = conversations(seed)
    assert found(spark, rows, block=block, block_turns=block_turns, round_bits=round_bits, chunk=chunk) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = conversations(5, 30)
    assert len(brute(rows, 1)) == len(found(spark, rows, family=1)) and found(spark, rows, family=1) == brute(rows, 1)


def test_empty_and_turnless(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "a", "b")]) == []
    short = [(c, 0, "user", "only") for c in range(1, 20)]      # without the head of the family, whose turns would stand in
    assert found(spark, short) == brute(short)
