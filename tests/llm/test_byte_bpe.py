"""Byte-level encoding by distinct words against the tiktoken library."""
import random

import numpy as np
import pytest

from gridlake.llm import byte_bpe

TRICKY = ["", " ", "a", "It's we've I'll ...'s 'd''re", "'sx !'s ''s  '", "Äö̈ ÉCOLE é ́x", "x<|endoftext|>y", "１२३ 漢字かな　全角  nb\xa0z",
          "a\x1cb\x85c \x85", "😀😀👩‍👩‍👧 ﬁ ẞ İI", "\t\n\x0b\x0c\r x", "a  \n\n b", "   ", "½²³¹ªº×÷", "࢏౜⃁ \U00011de0\U00011de1 1\U00011de2", "\x00a\x00 \x7f"]


@pytest.fixture(scope="module")
def library():
    return byte_bpe.library(byte_bpe.vocabulary())


def texts():
    rng = random.Random(7)
    yield from TRICKY
    for alphabet in ("ab", "abcdefgh ", "thein's.", "aÄß漢😀'1 ", ".,!'s \n", "aéßÖ'sdm.1 \xa0\t", "".join(chr(rng.randrange(0x20, 0xD000)) for _ in range(3000)) + "  "):
        for n in (1, 7, 300, 3000):
            yield "".join(rng.choice(alphabet) for _ in range(n))


def test_pretokens_are_the_pieces_of_the_library(library):
    for t in texts():
        pieces = byte_bpe.pretokens(t)
        assert "".join(pieces) == t
        assert [i for p in pieces for i in library._encode_single_piece(p)] == library.encode_ordinary(t), t[:80]


def test_classes_follow_the_library(library):
    for start in range(0, 0x20000, 0x1000):
        t = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
        assert [i for p in byte_bpe.pretokens(t) for i in library._encode_single_piece(p)] == library.encode_ordinary(t), start


@pytest.mark.parametrize("block", [1, 50, byte_bpe.BLOCK])
def test_spark_rows(spark, library, block):
    rows = [(i, t, "x", 1) for i, t in enumerate([*texts(), "word " * 3000, "ab" * 50000])] + [(500, None, "x", 2), (1, " ", "x", 3), (1, " ", "x", 3), (None, "no id", "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block long")
    got = sorted(((r["id"] or -1, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in byte_bpe.decoded(byte_bpe.encoded(docs, block=block, part_bytes=50_000)).collect()))
    want = sorted((i or -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    assert got == want


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encoded(docs).count() == 0
    rows = byte_bpe.decoded(spark.createDataFrame([(1, None), (2, bytearray())], "decoded long, ids binary")).collect()
    assert [r["decoded"] for r in rows] == [None, b""]
