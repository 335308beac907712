"""The pipeline against brute force over the smallest documents, and odd tables through every stage."""
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridlake.llm.bpe import vocabulary
from gridlake.llm.queries import SQL
from test_jaccard import brute as components
from test_suffix_dedup import brute as without_repeats

DIR = "/root/testdata/sf0.001"


def brute():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({SQL['op5_quality_cascade']}) WHERE kept").fetchall()}
    rows = [r for r in con.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall() if r[0] in kept]
    first = {i for i, _, c in components(rows) if i == c}
    rows = [r for r in rows if r[0] in first]
    library = Tokenizer.from_file(vocabulary())
    out = {}
    for (i, t), (rest, _) in zip(rows, without_repeats([t.encode() for _, t in rows], 200)):
        if rest.decode("utf-8", "ignore"):
            out[i] = library.encode(rest.decode("utf-8", "ignore"), add_special_tokens=False).ids + [2]
    return out


def test_run_equals_brute_force(spark):
    """The smallest table's labels are all told right, so that the language stage keeps every document."""
    want, got = brute(), defaultdict(list)
    for r in corpus_pipeline.run(spark, DIR).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(got) == set(want) and len(want) > 100
    for i, parts in got.items():
        parts.sort()
        assert sum(p[1] for p in parts) == parts[0][2] == len(want[i])
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts][:-1]]).tolist()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, ids string, rep long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, name, stage):
    text = " ".join(f"wort{k % 97} und{k}" for k in range(200))
    rows = [(1, text, "de", "a", 5), (1, text, "de", "a", 5), (2, None, None, None, None), (None, text + " x", "de", "a", 7), (3, "", "en", "a", 0),
            (4, "the word " * 20000, None, "b", 9), (5, "the " + text, "en", None, None)]
    docs = spark.createDataFrame([(*r, True, 1.0, "x", 1) for r in rows], SCHEMA)
    out = stage(spark, docs, DIR)
    assert out.count() > 0
    assert stage(spark, docs.limit(0), DIR).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == list(corpus_pipeline.COLUMNS)


def test_packing_sends_one_table_however_many_blocks(spark, monkeypatch):
    """The driver once built and sent every part of the index of seeds, each for a pass over all documents."""
    from gridlake.llm import packing
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(packing, "BLOCK_SEEDS", 4)
    monkeypatch.setattr(corpus_pipeline, "packed", lambda docs: packing.packed(docs, window=256, shard_tokens=10_000))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = corpus_pipeline.packing(spark, docs, DIR).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    tables = [x for x in sent if isinstance(x, packing.Router)]
    assert len(tables) == 1 and len(tables[0].cuts) > 20
    assert not any(isinstance(x, packing.Seeds) for x in sent)
    assert len(got) == docs.count() and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)
