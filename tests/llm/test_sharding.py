"""Balance, slots and groups of the sharding."""
import zlib
from collections import Counter, defaultdict

import numpy as np

from gridlake.llm.sharding import place, sharded


def test_place_prefers_the_best_dot_product():
    loads = np.array([[4, 1, 1], [1, 4, 1], [3, 1, 1], [1, 3, 1]], float)
    out = place(loads, 2)
    sums = np.array([loads[out == s].sum(axis=0) for s in range(2)])
    assert abs(sums[0] - sums[1]).max() <= 1


def test_sharded_rows(spark):
    rows = [(i, "hot text " * 9 if i % 3 == 0 else None if i == 1 else "w " * (i * 7 % 211) + str(i % 500), "x") for i in range(3000)]
    rows += [(5, "again", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = sharded(docs, 8, lot_rows=640).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, size, tokens, count, groups = defaultdict(list), Counter(), Counter(), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        tokens[r["shard"]] += r["tokens"]
        count[r["shard"]] += 1
        groups[bytes(r["group"])].add(r["shard"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    for c in (size, tokens, count):
        assert max(c.values()) <= 1.05 * min(c.values()), c
    assert sum(len(g) > 1 for g in groups.values()) == 1       # the hot one alone is split
    assert sorted(map(tuple, sharded(docs.repartition(2), 8, lot_rows=640).collect())) == sorted(map(tuple, got))
    assert sharded(docs.limit(0)).count() == 0


def test_groups_below_a_shard_stay_whole(spark):
    """Groups far above a lot's 64th, of which every one fits a shard of 500 rows, and one long text."""
    rows = [(i, f"group {i % 6} of copies" if i < 1200 else "long " * 600 if i == 1200 else f"text {i} " * (1 + i % 7)) for i in range(4000)]
    got = sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, lot_rows=640).collect()
    groups, size, count = defaultdict(set), Counter(), Counter()
    for r in got:
        groups[bytes(r["group"])].add(r["shard"])
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert len(got) == 4000 and all(len(g) == 1 for g in groups.values())
    for c in (size, count):
        assert max(c.values()) <= 1.05 * min(c.values()), c
