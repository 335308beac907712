"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens are exploded with their positions, block by block; a block names each of its words
once. The words of all blocks are shuffled by a hash of the word, each distinct word is encoded
once, its ids go back to the blocks that have it, and the positions put the documents together.
Decoding joins ids with the table of token bytes. Every match of the pattern is encoded by
itself, so the ids are those of the tiktoken library."""
from __future__ import annotations

import base64
import re
from array import array
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from gridlake.llm.blocks import Codes, block_number, bucketed, gathered, packed_codes, unpacked_codes
from gridlake.llm.shared import small_batches, text_or_empty

#: Pre-tokens per block; a longer document is a block of its own.
BLOCK = 1 << 21
#: Bytes of text per part of the vocabulary: the rows of one part name at most the words of about so much text.
PART_BYTES = 1 << 27
_LATIN, _BASIC = re.compile("[\x00-\xff]*"), re.compile("[\x00-\uffff]*")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def library(path: str):
    """The tiktoken encoding of a file of ranks."""
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in the order of ids, and where each id's begin. As long as the vocabulary."""
    table = ranks(path)
    tokens = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=starts[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), starts


def _library_class(members: str, characters: str) -> set[str]:
    """The characters that the library's own tables count as members: encoding bytes one by one shows what matched."""
    import tiktoken
    found = tiktoken.Encoding("class", pat_str=members, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bytes(found.encode_ordinary(characters)).decode())


def _as_class(characters) -> str:
    """The inside of a character class, as ranges."""
    points = np.array(sorted(map(ord, characters)))
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(f"\\U{part[0]:08X}-\\U{part[-1]:08X}" for part in np.split(points, cuts))


@cache
def _pattern(top: int):
    """The public pattern over code points below `top`, with the letters, digits and spaces of the library's tables,
    which are of another version of Unicode than Python's. The fewer code points, the faster its classes."""
    every = "".join(chr(c) for c in range(top) if not 0xD800 <= c < 0xE000)
    letter, digit, space = (_as_class(_library_class(c, every)) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


def pretokens(text: str) -> list[str]:
    """The matches of the public pattern in order; characters that nothing matches do not occur."""
    top = 1 << 8 if _LATIN.fullmatch(text) else 1 << 16 if _BASIC.fullmatch(text) else 0x110000
    return _pattern(top).findall(text)


def _packed(items: list[bytes]) -> bytes:
    """Byte strings in a row, compressed: their lengths, then their bytes."""
    lengths = packed_codes(np.array([len(x) for x in items], np.uint32))
    return zstandard.compress(len(items).to_bytes(4, "little") + lengths + b"".join(items))


def _unpacked(data: bytes) -> tuple[bytes, list[int]]:
    """The bytes of all items and the bounds between them."""
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(unpacked_codes(data[4:4 + 4 * n]), out=bounds[1:])
    return data[4 + 4 * n:], bounds.tolist()


_NUMBERS, _DOCUMENT = -1, -2        # rows of a block that hold no part of its words


def encoded(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (id, ids): one per row of docs, ids as little-endian unsigned 32-bit integers.

    Null text is empty and gives no ids; a null or repeated id gives a row for each of its rows;
    other columns are not read. A block's words travel in parts by a hash of the word, a part's
    words packed together in the order of their codes; the parts' number follows the bytes of all
    texts, so a task that encodes one part holds a bounded share of the vocabulary of the corpus.
    Pre-tokens are written once to the shared folder, so calling this is a Spark job. A task holds
    one block (or one longer document) at a time."""
    path = path or vocabulary()
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("id", to_arrow_type(kind)), ("data", pa.binary())])
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))

    def explode(batches):
        words, ids, codes, n, k = Codes(), [], [], 0, 0

        def flush():
            counts = np.bincount(np.concatenate(codes), minlength=len(words))
            order = np.argsort(-counts, kind="stable")      # frequent words get small codes
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number, names = block_number(k), [w.encode() for w in words]
            names = [names[w] for w in order.tolist()]
            part = np.array([crc32(w) % n_parts for w in names], np.int64)
            by_part = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by_part], prepend=-1))
            whole = [{"block": number, "part": _NUMBERS, "data": packed_codes(part)}]
            for own in np.split(by_part, cuts[1:]) if len(part) else []:
                whole.append({"block": number, "part": int(part[own[0]]), "data": _packed([names[w] for w in own.tolist()])})
            for a in range(0, len(whole), 1000):
                yield pa.RecordBatch.from_pylist(whole[a:a + 1000], schema=schema)
            for a in range(0, len(ids), 1000):
                some = ids[a:a + 1000]
                yield pa.RecordBatch.from_pydict({"block": [number] * len(some), "part": [_DOCUMENT] * len(some), "id": some,
                                                  "data": [packed_codes(rank[c]) for c in codes[a:a + 1000]]}, schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.array(list(map(words.__getitem__, pretokens(text))), np.int32)
                ids.append(i)
                codes.append(own)
                n += len(own) + 1
                if n > block:
                    yield from flush()
                    words, ids, codes, n, k = Codes(), [], [], 0, k + 1
        if ids:
            yield from flush()

    def encode(rows: pa.Table) -> pa.Table:
        core, known, out = library(path), {}, []
        for data in rows["data"].to_pylist():
            flat, bounds = _unpacked(data)
            own = []
            for a, b in zip(bounds, bounds[1:]):
                word = flat[a:b]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = array("I", core._encode_single_piece(word)).tobytes()
                own.append(ids)
            out.append(_packed(own))
        return pa.table({"block": rows["block"], "part": rows["part"], "data": pa.array(out, pa.binary())})

    def assemble(rows: pa.Table, words: pa.Table) -> pa.Table:
        part_of = next(d for p, d in zip(rows["part"].to_pylist(), rows["data"].to_pylist()) if p == _NUMBERS)
        by_part = np.argsort(unpacked_codes(part_of), kind="stable")
        flat, lengths = [], []
        for data in [d for _, d in sorted(zip(words["part"].to_pylist(), words["data"].to_pylist()))]:
            some, bounds = _unpacked(data)
            flat.append(some)
            lengths.append(np.diff(bounds) // 4)
        starts = np.zeros(len(by_part) + 1, np.int64)       # in the order of the parts
        np.cumsum(np.concatenate([np.empty(0, np.int64), *lengths]), out=starts[1:])
        flat, bounds = gathered(np.frombuffer(b"".join(flat), "<u4"), starts, np.argsort(by_part))      # now in the order of codes
        of_documents = rows.filter(pc.equal(rows["part"], _DOCUMENT))
        made = [gathered(flat, bounds, unpacked_codes(c))[0].tobytes() for c in of_documents["data"].to_pylist()]
        return pa.table({"id": of_documents["id"], "ids": pa.array(made, pa.binary())})

    id_type = kind.simpleString()
    parts = bucketed(rows.mapInArrow(explode, f"block long, part int, id {id_type}, data binary"), "pretokens")
    words = parts.filter("part >= 0").select("block", "part", "data").groupBy("part").applyInArrow(encode, "block long, part int, data binary")
    whole = parts.filter("part < 0")
    return whole.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, f"id {id_type}, ids binary")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded`, the bytes of binary `ids`; null ids give null.

    The join with the token-byte table is a gather: the table has one row per id of the vocabulary,
    so every task holds it and nothing is shuffled. An unknown id is an error."""
    path = path or vocabulary()
    names = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        flat, starts = token_bytes(path)
        for batch in batches:
            out = [None if x is None else gathered(flat, starts, np.frombuffer(x, "<u4"))[0].tobytes()
                   for x in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    rows = rows.select(*names)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))
