"""Encoding against the tokenizers library, whole and by tree concatenation."""
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridlake.llm import bpe

TRICKY = ["", " ", "a", "It's we've I'll ...'s 'd''re", "Äö̈ ÉCOLE é ́x", "x<|endoftext|>y <|startoftext|>", "१२३ 漢字かな　全角  nb z",
          "a\x1cb\x85c", "😀😀👩‍👩‍👧 ﬁ ẞ İI", "\t\n\x0b\x0c\r x",
          "ÀÖØÞß öøÿ÷×ªº¼½ naïve Ünder l'été'll 'RE can'T '''s''re ''m'd 12ab3é", "<| x <|end", "A_b-C/d{}[]~^`"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def texts():
    rng = random.Random(5)
    yield from TRICKY
    for alphabet in ("ab", "abcdefgh ", "thein's.", "aÄß漢😀'1 ", "aaaaab", ".,!'s ", "aéßÖ'sdm.1 "):
        for n in (1, 7, 300, 3000):
            yield "".join(rng.choice(alphabet) for _ in range(n))


def test_ids_equal_the_library(library):
    enc = bpe.encoder(bpe.vocabulary())
    for t in texts():
        e = library.encode(t, add_special_tokens=False)
        ids = np.frombuffer(enc.ids(t), "<u4").tolist()
        assert ids == e.ids
        assert enc.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_places_equal_the_library(library):
    enc = bpe.encoder(bpe.vocabulary())
    for t in texts():
        e = library.encode(t, add_special_tokens=False)
        ids, starts, ends = enc.placed(t, 5)
        assert ids.tolist() == e.ids and [(a - 5, b - 5) for a, b in zip(starts.tolist(), ends.tolist())] == e.offsets, t[:60]


@pytest.mark.parametrize("leaf", [3, 17, 200])
def test_tree_concatenation_equals_the_library(library, leaf):
    enc = bpe.encoder(bpe.vocabulary())
    for t in texts():
        if len(t) > leaf:
            assert np.frombuffer(bpe.encode_tree(enc, t, leaf), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, (leaf, t[:80])


def test_spark_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*texts(), "word " * 3000, "ab" * 5000])] + [(500, None, "x"), (1, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in bpe.decoded(bpe.encoded(docs, leaf=1000)).collect())
    want = sorted((i, e.ids, library.decode(e.ids, skip_special_tokens=False)) for i, t, _ in rows for e in [library.encode(t or "", add_special_tokens=False)])
    assert got == want
    assert bpe.encoded(docs.limit(0)).count() == 0
