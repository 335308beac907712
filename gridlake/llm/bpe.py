"""BPE encoding and decoding with a public tokenizer; long texts by tree concatenation.

A text without splits for long stretches cannot be cut at word borders. Long texts are
therefore halved down to leaves wherever the cut falls, the leaves are encoded in parallel
as rows of their own, and the tree is climbed by joining neighbours: a window around each
join is encoded anew and grown until it shares one whole token (same place, same id) with
either side. Adjacent token pairs then all come from correct encodings, which makes the
whole sequence the encoding of the whole text."""
from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from gridlake.llm.shared import given_back, small_batches, text_or_empty

#: Texts with more characters than this are cut; a leaf has at most half as many.
LEAF = 1 << 16
#: Words kept with their ids per Python worker before the older half is forgotten; all are forgotten when a task ends,
#: as an idle worker keeps its memory.
KEPT_WORDS = 250_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts of these characters only are the same after NFC, and their pre-tokens (of the lower-cased text) are those of
#: the second pattern; all other texts take the library's own normalizer and pre-tokenizer, word by word.
_PLAIN = re.compile(r"[\x09-\x0D -~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D a-z0-9ß-öø-ÿ]+")
_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """One encoder per tokenizer file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Encodes as the tokenizers library does, without special tokens, truncation or padding.

    The pre-tokenizer of the word vocabulary never joins characters across a space or line
    break and its normalizer never composes across one, so a text's ids are the ids of its
    words in order; words are encoded once and kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.strings = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # the byte alphabet: printable bytes are themselves, the others follow from code point 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        self.byte_letters = {x: chr(x) for x in printable} | {x: chr(256 + k) for k, x in enumerate(others)}
        self.plain = path.endswith("word_bpe_49k.json")     # whose patterns the fast way knows
        self.spans: dict[str, list[tuple[int, int, int]]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the whole tokenizer, in one call."""
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False))}

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens by the model alone; characters beyond ASCII are spelt as the byte alphabet spells them."""
        tokenize, table = self.tokenizer.model.tokenize, self.byte_letters
        found = {}
        for p in pieces:
            spelt = p if p.isascii() else "".join([table[x] for x in p.encode()])
            found[p] = np.array([t.id for t in tokenize(spelt)], "<u4").tobytes()
        return found

    def _spans(self, piece: str) -> list[tuple[int, int, int]]:
        """(id, first character, past the last character) of a pre-token's tokens."""
        if piece not in self.spans:
            if len(self.spans) > KEPT_WORDS // 4:
                self.spans.clear()
            spelt = piece if piece.isascii() else "".join([self.byte_letters[x] for x in piece.encode()])
            # the character of each byte of the spelling, in which the model counts
            letter = [k for k, c in enumerate(piece) for x in c.encode() for _ in self.byte_letters[x].encode()]
            self.spans[piece] = [(t.id, letter[t.offsets[0]], letter[t.offsets[1] - 1] + 1) for t in self.tokenizer.model.tokenize(spelt)]
        return self.spans[piece]

    def _kept(self, units: list[str], learn) -> bytes:
        """The units' ids in order. Ids are kept; the store is renewed when full, what is used again moves over."""
        young, old = self.young, self.old
        missing = [w for w in set(units) if w not in young]
        if missing:
            if len(young) > KEPT_WORDS:
                self.old, self.young = young, {}
                young, old, missing = self.young, young, list(set(units))
            new = []
            for w in missing:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
            if new:
                young.update(learn(new))
        return b"".join([young[w] for w in units])

    def ids(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            return self._kept(_PIECE.findall(text.lower()), self._pieces)
        return self._kept(_WORD.findall(text), self._words)

    def forget(self) -> None:
        for store in (self.young, self.old, self.spans):
            store.clear()

    def placed(self, text: str, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the tokens; `at` is where the text begins. A token that ends inside a character covers it."""
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            ids, starts, ends = [], [], []
            for m in _PIECE.finditer(text.lower()):
                own, begin = self._spans(m[0]), at + m.start()
                for i, a, b in own:
                    ids.append(i)
                    starts.append(begin + a)
                    ends.append(begin + b)
            return np.array(ids, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return np.array(e.ids, np.int64), spans[:, 0], spans[:, 1]

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False); the file has no decoder, so tokens are joined by spaces."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(list(map(int, ids)), skip_special_tokens=False)
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def _same(a, ia: int, b, ib: int) -> bool:
    return all(x[ia] == y[ib] for x, y in zip(a, b))


def _last_shared(side, window, before: int):
    """The last token of `side` that ends before the cut and that the window has too."""
    ids, starts, ends = side
    place = {(int(s), int(e), int(i)): k for k, (i, s, e) in enumerate(zip(*window))}
    low = int(window[1][0]) if len(window[1]) else before
    for k in range(bisect_right(ends, before) - 1, bisect_left(starts, low) - 1, -1):
        j = place.get((int(starts[k]), int(ends[k]), int(ids[k])))
        if j is not None and j > 0 and starts[k] < ends[k]:
            return k, j
    return None


def _first_shared(side, window, after: int, top: int):
    """The first token of `side` that starts after the cut and that the window has too, before the window's last token."""
    ids, starts, ends = side
    place = {(int(s), int(e), int(i)): k for k, (i, s, e) in enumerate(zip(*window))}
    for k in range(bisect_left(starts, after), bisect_right(ends, top)):
        j = place.get((int(starts[k]), int(ends[k]), int(ids[k])))
        if j is not None and j + 1 < len(window[0]) and starts[k] < ends[k]:
            return k, j
    return None


def join_encodings(enc: Encoder, text: str, left, right, cut: int, begin: int, end: int, window: int = 64):
    """The encoding of text[begin:end] from those of text[begin:cut] and text[cut:end].

    The first token of a window and the last one may owe their shape to the window's own
    borders and never count as shared, unless the window reaches the end of the text there."""
    while True:
        low, high = max(begin, cut - window), min(end, cut + window)
        mid = enc.placed(text[low:high], low)
        a = _last_shared(left, mid, cut - 1) if low > begin else (-1, -1)
        b = _first_shared(right, mid, cut + 1, high) if high < end else (len(right[0]), len(mid[0]))
        if a is not None and b is not None and a[1] < b[1]:
            return tuple(np.concatenate([x[:a[0] + 1], m[a[1] + 1:b[1]], y[b[0]:]]) for x, m, y in zip(left, mid, right))
        if low == begin and high == end:
            return mid
        window *= 2


def leaf_bounds(n: int, leaf: int = LEAF // 2) -> list[int]:
    """Borders of the leaves that halving gives."""
    if n <= leaf:
        return [0, n]
    half = n // 2
    return leaf_bounds(half, leaf)[:-1] + [half + x for x in leaf_bounds(n - half, leaf)]


def climb(enc: Encoder, text: str, bounds: list[int], leaves: list):
    """Joins neighbours level by level up to the root."""
    while len(leaves) > 1:
        up, marks = [], [0]
        for k in range(0, len(leaves) - 1, 2):
            up.append(join_encodings(enc, text, leaves[k], leaves[k + 1], bounds[k + 1], bounds[k], bounds[k + 2]))
            marks.append(bounds[k + 2])
        if len(leaves) % 2:
            up.append(leaves[-1])
            marks.append(bounds[-1])
        leaves, bounds = up, marks
    return leaves[0]


def encode_tree(enc: Encoder, text: str, leaf: int) -> bytes:
    """The same on one machine, for tests."""
    bounds = leaf_bounds(len(text), leaf)
    parts = [enc.placed(text[a:b], a) for a, b in zip(bounds, bounds[1:])]
    return climb(enc, text, bounds, parts)[0].astype("<u4").tobytes()


def encoded(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", leaf: int = LEAF // 2, width: int = 4) -> DataFrame:
    """Rows (id, ids): one per document, ids as little-endian unsigned integers of `width` bytes (4, or 2 for small vocabularies).

    Null text is empty and gives no ids; repeated rows give repeated results. Texts up to two
    leaves long are encoded where they are read. Longer ones become one row per leaf, dealt
    over all tasks; only their leaves are shuffled, and a task joins one text at a time."""
    path = path or vocabulary()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("t"))

    def narrow(ids: bytes) -> bytes:
        return ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()

    @given_back
    def short(batches):
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([narrow(enc.ids(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["id", "ids"])
        enc.forget()

    def cut(batches):
        for batch in batches:
            out = {"row": [], "id": [], "k": [], "n": [], "piece": []}
            for row, i, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                bounds = leaf_bounds(len(t), leaf)
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for name, value in zip(out, (row, i, k, len(bounds) - 1, t[a:b])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pieces)

    @given_back
    def leaves(batches):
        enc = encoder(path)
        for batch in (b.slice(k, 32) for b in batches for k in range(0, b.num_rows, 32)):
            made = [enc.placed(t) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([m[c].astype("<i4").tobytes() for m in made], pa.binary()) for c in range(3))],
                schema=encoded_pieces)
        enc.forget()

    @given_back
    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path)
        pdf = pdf.sort_values("k")
        bounds = [0, *np.cumsum([len(p) for p in pdf["piece"]]).tolist()]
        parts = [tuple(np.frombuffer(x, "<i4").astype(np.int64) + shift for x, shift in zip(p, (0, at, at)))
                 for p, at in zip(zip(pdf["ids"], pdf["starts"], pdf["ends"]), bounds)]
        ids = climb(enc, "".join(pdf["piece"]), bounds, parts)[0]
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "ids": [ids.astype(f"<u{width}").tobytes()]})

    kind = docs.schema[id_column].dataType
    pieces = pa.schema([("row", pa.int64()), ("id", to_arrow_type(kind)), ("k", pa.int32()), ("n", pa.int32()), ("piece", pa.string())])
    encoded_pieces = pa.schema([*pieces, ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
    id_type = kind.simpleString()
    long = F.char_length("t") > 2 * leaf
    few = rows.filter(~long).mapInArrow(short, f"id {id_type}, ids binary")
    cuts = (rows.filter(long).select(F.monotonically_increasing_id().alias("row"), "id", "t")
            .mapInArrow(cut, f"row bigint, id {id_type}, k int, n int, piece string").repartition("row", "k"))
    parts = cuts.mapInArrow(leaves, f"row bigint, id {id_type}, k int, n int, piece string, ids binary, starts binary, ends binary")
    return few.unionByName(parts.groupBy("row", "id").applyInPandas(joined, f"id {id_type}, ids binary"))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded` to rows with binary `ids`; null ids give null."""
    path = path or vocabulary()
    names = [c for c in rows.columns if c != "decoded"]

    @given_back
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(np.frombuffer(x, "<u4").tolist())
                     for x in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    rows = rows.select(*names)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
