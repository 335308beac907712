"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text."""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import given_back, small_batches

#: Code point ranges of scripts (first, last, name); letters elsewhere are script 0.
SCRIPT_RANGES = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x2FA1F, "Han"),
)
SCRIPTS = ["other", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES)]
#: Buckets of hashed letter n-grams (of one, two and three letters), a bound on the model's size.
BUCKETS = 1 << 16
#: Documents of each language that train the model at most, about.
TRAIN_DOCS = 20_000
#: Log odds that a change of language between two words must overcome.
SWITCH_PENALTY = 8.0
#: A script counts as a language's own from this share of its training letters on.
SCRIPT_SHARE = 0.001
_LETTERS: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Script of every code point that is a letter, -1 of all others."""
    if not _LETTERS:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        table = np.zeros(0x110000, np.int8)
        for first, last, name in SCRIPT_RANGES:
            table[first:last + 1] = SCRIPTS.index(name)
        table[~letter] = -1
        _LETTERS.append(table)
    return _LETTERS[0]


@dataclass
class Words:
    """The words (maximal runs of letters) of a batch of texts and the n-grams inside them."""

    doc: np.ndarray         # text of each word
    start: np.ndarray       # first code point of each word, in its text
    end: np.ndarray
    script: np.ndarray      # of the word's first letter
    begin: np.ndarray       # where the word's letters begin in `grams`
    grams: np.ndarray       # a row of three buckets per letter


def letters_of(texts: list[str]) -> Words:
    """Lower-cased text by text as a whole; a text whose length changes so is lower-cased letter by letter."""
    lowered = []
    for t in texts:
        low = t.lower()
        lowered.append(low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t))
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_table()[codes] if len(codes) else np.empty(0, np.int8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = script >= 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    doc = np.searchsorted(bounds, start, side="right") - 1
    # non-letters count as one border sign, so that n-grams see where words begin and end
    sign = np.where(script >= 0, codes, 0).astype(np.uint64)
    before = np.concatenate([[0], sign[:-1]]).astype(np.uint64) if len(sign) else sign
    after = np.concatenate([sign[1:], [0]]).astype(np.uint64) if len(sign) else sign
    m = np.uint64(0x9E3779B97F4A7C15)
    one = sign * m
    two = (before * np.uint64(0x110000) + sign) * m + np.uint64(1)
    three = ((before * np.uint64(0x110000) + sign) * np.uint64(0x110000) + after) * m + np.uint64(2)
    at = np.flatnonzero(script >= 0)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    grams = np.stack([((x[at] * m) ^ (x[at] >> np.uint64(31))) * m >> shift for x in (one, two, three)], axis=1).astype(np.int64)
    lengths = end - start
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
    return Words(doc, start - bounds[doc], end - bounds[doc], script[start], begin, grams)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray         # float32, buckets x languages: log probability of an n-gram against the mean over languages
    scripts: np.ndarray         # bool, scripts x languages


def _batches(batch: pa.RecordBatch, size: int = 1 << 19):
    """Row ranges of a batch with about `size` characters each; a longer text stands alone."""
    lengths = [len(t) if t else 0 for t in batch]
    a, total = 0, 0
    for k, n in enumerate(lengths):
        if k > a and total + n > size:
            yield a, k
            a, total = k, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """A model from rows (doc_id, text, lang); null texts and labels are left out.

    Of a language with more than `max_docs` documents a hash of doc_id takes about that
    many: the documented bound of the training sample. Tasks add up n-gram counts per
    language; what reaches the driver is bounded by buckets times languages."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    number = {name: k for k, name in enumerate(names)}
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    large = {name: n for name, n in sizes.items() if n > max_docs}
    keep = F.lit(True)
    for name, n in large.items():
        keep = keep & ((F.col("lang") != name) | (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_docs / n)))

    @given_back
    def run(batches):
        counts = np.zeros((len(names), BUCKETS), np.int64)
        seen = np.zeros((len(names), len(SCRIPTS)), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), [number[x] for x in batch.column(1).to_pylist()]
            for a, b in _batches(texts):
                words = letters_of(texts[a:b])
                lang = np.array(langs[a:b])[words.doc]
                per_letter = np.repeat(lang, words.end - words.start)
                for k in range(len(names)):
                    counts[k] += np.bincount(words.grams[per_letter == k].ravel(), minlength=BUCKETS)
                    seen[k] += np.bincount(np.repeat(words.script, words.end - words.start)[per_letter == k], minlength=len(SCRIPTS))
        both = np.concatenate([counts, seen], axis=1)
        lang, cell = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(both[lang, cell], pa.int64())], ["lang", "cell", "n"])

    both = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    for r in rows.filter(keep).select("text", "lang").mapInArrow(run, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
        both[r["lang"], r["cell"]] = r["n"]
    counts, seen = both[:, :BUCKETS], both[:, BUCKETS:]
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    own = seen >= np.maximum(SCRIPT_SHARE * seen.sum(axis=1, keepdims=True), 1)
    return Model(names, (logs - logs.mean(axis=0)).T.astype(np.float32), own.T)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Log score of every word under every language; languages that do not use the word's script fall behind by a fixed amount."""
    if not len(words.begin):
        return np.empty((0, len(model.languages)), np.float32)
    letters = model.weights[words.grams[:, 0]]
    for k in (1, 2):
        letters = letters + model.weights[words.grams[:, k]]
    # neighbouring n-grams overlap: a third of the sum counts each letter once
    scores = np.add.reduceat(letters, words.begin, axis=0) / 3
    allowed = model.scripts[words.script]
    return np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, scores - 50.0)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of runs of words. scores: texts x words x languages, zero where a text has ended; the result is texts x words."""
    n, steps, k = scores.shape
    best = np.zeros((n, k), np.float32)
    stay = np.empty((steps, n, k), bool)
    source = np.empty((steps, n), np.int16)
    rows = np.arange(n)
    for t in range(steps):
        source[t] = best.argmax(axis=1)
        jump = best[rows, source[t]][:, None] - penalty
        stay[t] = best >= jump
        best = np.where(stay[t], best, jump) + scores[:, t]
        best -= best.max(axis=1, keepdims=True)
    out = np.empty((n, steps), np.int16)
    label = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        out[:, t] = label
        label = np.where(stay[t, rows, label], label, source[t])
    return out


def label_words(model: Model, words: Words, n_texts: int, penalty: float = SWITCH_PENALTY, cells: int = 1 << 19) -> np.ndarray:
    """Language number of each word. Texts of similar length go through Viterbi together."""
    scores = word_scores(model, words)
    counts = np.bincount(words.doc, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(len(scores), np.int16)
    order = [k for k in np.argsort(counts, kind="stable") if counts[k]]
    while order:
        size = max(1, cells // max(1, int(counts[order[-1]])))
        group, order = order[-size:], order[:-size]
        block = np.zeros((len(group), int(counts[group[-1]]), len(model.languages)), np.float32)
        for row, k in enumerate(group):
            block[row, :counts[k]] = scores[begin[k]:begin[k + 1]]
        labels = viterbi(block, penalty)
        for row, k in enumerate(group):
            out[begin[k]:begin[k + 1]] = labels[row, :counts[k]]
    return out


def identified(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """All rows and columns of `docs` with lang_pred, score and spans.

    spans: array of (begin, end, lang), code points of the text from the first to past the last
    letter of a run of words in one language. lang_pred has most letters (ties: the first in
    order), score is its share of them. A null text or one without a letter is `und` with score
    0 and no spans, as is every text if nothing was learned. Columns of `docs` with these names
    are replaced. Whole texts are read, in batches of bounded size or alone."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "spans")
    packed = pickle.dumps(model)
    names = docs.columns
    at = names.index("text")
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    @given_back
    def run(batches):
        model = pickle.loads(packed)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for a, b in _batches(texts) if model.languages else ():
                words = letters_of([t or "" for t in texts[a:b]])
                labels = label_words(model, words, b - a, penalty)
                size = words.end - words.start
                share = np.zeros((b - a, len(model.languages)))
                np.add.at(share, (words.doc, labels), size)
                # a run ends where the text or the language changes
                if len(labels):
                    change = np.flatnonzero((np.diff(labels) != 0) | (np.diff(words.doc) != 0)) + 1
                    for x, y in zip([0, *change.tolist()], [*change.tolist(), len(labels)]):
                        spans[a + int(words.doc[x])].append({"begin": int(words.start[x]), "end": int(words.end[y - 1]), "lang": model.languages[labels[x]]})
                for k in np.flatnonzero(share.any(axis=1)):
                    top = int(share[k].argmax())
                    langs[a + k], scores[a + k] = model.languages[top], float(share[k, top] / share[k].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)],
                                             [*names, "lang_pred", "score", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>")


def held_out(column: str = "doc_id") -> Column:
    """Documents that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2, F.lit(False))
