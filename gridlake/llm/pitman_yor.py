"""A hierarchical Pitman-Yor language model: Gibbs sampled seatings, averaged predictive probabilities.

Restaurants: one per preceding word, so as many as there are words (the start of a text counts as
one); all share the unigram restaurant as parent, whose base is uniform over the known words and
one unknown word. A dish is a word, and given the restaurants' totals the seating of one word does
not touch that of another. So counts are grouped by word: a word's customers and tables in all
restaurants lie in one task, and between sweeps only the totals of the restaurants are exchanged:
each group sends what its words have in the contexts it needs, parts of the contexts add these up
and reply to the groups in the same order. All of it stays in tables.

In a sweep all customers of a word leave a restaurant and are seated anew, one after the other,
given all others (blocked Gibbs); tables are customers of the parent. The number of
tables of a word is all that predictions need.

Texts are read once. Blocks of documents send the sorted distinct (word, context) pairs they contain
to the words' groups and keep per document the places of its tokens in that list; groups answer
with one probability per pair in the same order. Scores are sums over the answers."""
from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.blocks import bucketed
from gridlake.llm.shared import given_back, joined_words, lower_ascii, small_batches, stored, text_or_empty

SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
#: Bytes of text per block and, about, per word group; constants.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 16 << 20
_WORD_BITS = 56
_MASK = np.uint64((1 << _WORD_BITS) - 1)
END = np.uint64(0x3C6EF372FE94F8) & _MASK


def packed(values: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers and small differences take little room."""
    return zlib.compress(values.dtype.str.encode() + b"|" + np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    kind, _, raw = zlib.decompress(blob).partition(b"|")
    dtype = np.dtype(kind.decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, len(raw) // dtype.itemsize).T).view(dtype).ravel()


def group_of(words: np.ndarray, groups: int) -> np.ndarray:
    """Groups are ranges of hashes, so sorted words are sorted by group."""
    return ((words >> np.uint64(_WORD_BITS - 24)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)


def token_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (hashes, an end token after each text), their contexts, and each token's text.

    The context is the preceding word; the end token stands before the first word of a text."""
    hashes, bounds = joined_words([lower_ascii(t.encode("utf-8", "surrogatepass")) for t in texts])
    sizes = np.diff(bounds) + 1
    doc = np.repeat(np.arange(len(texts)), sizes)
    words = np.empty(len(doc), np.uint64)
    is_end = np.zeros(len(doc), bool)
    is_end[np.cumsum(sizes) - 1] = True
    words[is_end], words[~is_end] = END, hashes & _MASK
    return words, np.concatenate([[END], words[:-1]]), doc


def block_rows(number: int, ids: list, texts: list[str], held: np.ndarray, groups: int):
    """(kind, block, group, blob): the block's documents (kind 0, a group below zero), its requests by group (kind 1)."""
    words, context, doc = token_stream(texts)
    order = np.lexsort((context, words))
    w, u = words[order], context[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])])
    pair = np.empty(len(w), np.int64)
    pair[order] = np.cumsum(new) - 1
    count = np.bincount(pair, ~held[doc], int(new.sum())).astype(np.uint32)
    w, u = w[new], u[new]
    del order, new, words, context
    # a document's places, sorted, as differences
    by_doc = np.lexsort((pair, doc))
    places, sizes = pair[by_doc], np.bincount(doc, minlength=len(texts))
    steps = np.diff(places, prepend=0)
    first = np.cumsum(sizes) - sizes
    steps[first] = places[first]
    rows = [(0, number, -1 - (number >> 32) - (number & 0xFFFF) * 8191, pickle.dumps((ids, held, sizes.astype(np.uint32), packed(steps.astype(np.uint32)))))]
    g = group_of(w, groups)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
    for a, b in zip(cuts, cuts[1:]):
        rows.append((1, number, int(g[a]), pickle.dumps(coded_pairs(w[a:b], u[a:b], count[a:b]))))
    return rows


def coded_pairs(w, u, count, contexts=None):
    """Pairs sorted by word and context: differences of the distinct words, pairs per word, differences
    of the contexts (those of the pairs, or a longer list), places of the pairs in them, counts."""
    contexts = np.unique(u) if contexts is None else contexts
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    at = np.flatnonzero(new)
    return (coded_hashes(w[at]), packed(np.diff(at, append=len(w)).astype(np.uint32)), coded_hashes(contexts),
            packed(np.searchsorted(contexts, u).astype(np.uint32)), packed(count))


def decoded_pairs(coded):
    """(words, places in the contexts, counts, contexts)."""
    words, contexts = decoded_hashes(coded[0]), decoded_hashes(coded[2])
    return np.repeat(words, unpacked(coded[1]).astype(np.int64)), unpacked(coded[3]), unpacked(coded[4]), contexts


def coded_hashes(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences."""
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def decoded_hashes(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def added(w, u, c):
    """Pairs sorted by word and context, equal ones as one with the sum of their counts."""
    order = np.lexsort((u, w))
    w, u, c = w[order], u[order], c[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
    at = np.flatnonzero(new)
    return w[at], u[at], np.add.reduceat(c, at) if len(c) else c


@dataclass
class Totals:
    """What the restaurants know of each other: customers and tables of the contexts at hand and at the root."""

    customers: np.ndarray       # per context
    tables: np.ndarray          # per context
    root_customers: float       # the tables of all contexts
    root_tables: float
    vocabulary: int
    tokens: int
    discounts: tuple[float, float]      # root, contexts


def discount(ones: float, twos: float) -> float:
    """The usual estimate from the counts of counts, kept away from 0 and 1."""
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


class Seating:
    """The words of one group: counts by word and context, and the numbers of their tables."""

    def __init__(self, w, u, c, contexts: int, seed: int):
        self.words, self.word = np.unique(w, return_inverse=True)
        self.u, self.c, self.contexts, self.seed = u.astype(np.int64), c.astype(np.int64), contexts, seed
        self.t = np.ones(len(c), np.int64)
        self.root_t = np.ones(len(self.words), np.int64)

    def root_customers(self):
        return np.bincount(self.word, self.t, len(self.words)).astype(np.int64)

    def parent(self, totals: Totals, customers, tables, gone=0):
        """Predictive probability of the root; `gone` customers have left it."""
        d, base = totals.discounts[0], 1.0 / (totals.vocabulary + 1)
        return ((customers - d * tables + (STRENGTH + d * totals.root_tables) * base)
                / (STRENGTH + np.maximum(totals.root_customers - gone, 0)))

    @staticmethod
    def seat(customers, weight, d, rng):
        """Tables after seating so many customers; `weight` is the pull of a new table.

        One by one up to 64 customers; beyond, in strides of a 64th of those seated, within which the
        chance of a new table is taken as constant."""
        tables = np.minimum(customers, 1)
        at = np.argsort(-customers, kind="stable")
        sizes, pull, seated = customers[at], weight[at], tables[at].astype(float)
        i, n = 1, len(at)
        while True:
            n = int(np.searchsorted(-sizes[:n], -i, side="left"))       # those with more than i customers
            if not n:
                break
            stride = max(1, i // 64)
            chance = pull[:n] / (pull[:n] + i - d * seated[:n])
            seated[:n] += rng.binomial(np.minimum(stride, sizes[:n] - i), np.clip(chance, 0, 1))
            i += stride
        out = np.empty(len(at), np.int64)
        out[at] = seated
        return out

    def sweep(self, number: int, totals: Totals):
        """Seats every word anew in every restaurant, given the others."""
        rng = np.random.Generator(np.random.Philox(key=[self.seed, number]))
        rest = self.root_customers()[self.word] - self.t
        # the tables of the root left by this restaurant's customers; with none left the dish is new there
        kept = np.minimum(self.root_t[self.word], rest)
        pull = (STRENGTH + totals.discounts[1] * totals.tables[self.u]) * self.parent(totals, rest, kept, self.t)
        self.t = self.seat(self.c, pull, totals.discounts[1], rng)
        base = (STRENGTH + totals.discounts[0] * totals.root_tables) / (totals.vocabulary + 1)
        self.root_t = self.seat(self.root_customers(), np.full(len(self.words), base), totals.discounts[0], rng)

    def figures(self) -> np.ndarray:
        """Sums that make the totals: customers and tables per context, then NUMBERS single numbers."""
        root = self.root_customers()
        single = [root.sum(), self.root_t.sum(), len(self.words), self.c.sum(), (self.c == 1).sum(), (self.c == 2).sum(), (root == 1).sum(), (root == 2).sum()]
        return np.concatenate([np.bincount(self.u, self.c, self.contexts), np.bincount(self.u, self.t, self.contexts), single])


NUMBERS = 8


def totals_of(figures: np.ndarray, k: int, discounts=None) -> Totals:
    root_customers, root_tables, vocabulary, tokens, ones, twos, root_ones, root_twos = figures[2 * k:]
    return Totals(figures[:k], figures[k:2 * k], root_customers, root_tables, int(vocabulary), int(tokens),
                  discounts or (discount(root_ones, root_twos), discount(ones, twos)))


def answers(seating: Seating, history: list[Totals], requests, burn_in: int):
    """For every request (w, u, _): log10 of the mean predictive probability and the word's count, per pair.

    history[k] are the totals before sweep k + 1, the last ones those after the last sweep."""
    words, n_samples = seating.words, max(len(history) - 1 - burn_in, 1)
    counts = np.bincount(seating.word, seating.c, len(words)).astype(np.uint32)
    keys = seating.word * seating.contexts + seating.u
    # per sample: shares of the parent by context, the parent's probabilities (the unknown word last); own shares of the pairs
    samples, own = [], np.zeros(len(keys))
    for number in range(1, len(history)):
        seating.sweep(number, history[number - 1])
        if number <= burn_in:
            continue
        now = history[number]
        d, size = now.discounts[1], STRENGTH + now.customers
        root = np.append(seating.parent(now, seating.root_customers(), seating.root_t), seating.parent(now, 0, 0))
        samples.append(((STRENGTH + d * now.tables) / size, root))
        own += (seating.c - d * seating.t) / size[seating.u]
    for w, u, *_ in requests:
        u = u.astype(np.int64)
        at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
        known = words[at] == w if len(words) else np.zeros(len(w), bool)
        key = at * seating.contexts + u
        pair = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        there = known & (keys[pair] == key) if len(keys) else known
        out = sum(share[u] * root[np.where(known, at, len(words))] for share, root in samples)
        out[there] += own[pair[there]]
        c = np.zeros(len(w), np.uint32)
        c[known] = counts[at[known]]
        yield np.log10(out / n_samples).astype(np.float32), c


def scored(docs: DataFrame, held_out: F.Column, sweeps: int = SWEEPS, burn_in: int = BURN_IN,
           block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model learns from all documents for which `held_out` is false. ASCII letters are
    lower-cased; null and empty texts consist of the end token. score is the sum of log10
    probabilities (single precision per token), base_score the additive unigram baseline. Repeated
    rows count and are scored each; other columns are ignored. Without training documents the
    vocabulary is empty and every token is unknown. Random numbers depend on the corpus alone."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))

    @given_back
    def read(batches):
        number, ids, texts, held, n = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for i, t, h in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(i)
                texts.append(t)
                held.append(h)
                n += len(t)
                if n >= block_bytes:
                    yield as_batch(block_rows(number, ids, texts, np.array(held), groups))
                    number, ids, texts, held, n = number + 1, [], [], [], 0
        if ids:
            yield as_batch(block_rows(number, ids, texts, np.array(held), groups))

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["kind", "block", "group", "blob"])

    # moved to the words' groups once, for the counts and for the answers
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(rows.mapInArrow(read, "kind int, block long, group int, blob binary").repartition(n_buckets, "group"), "blocks", "group")
    requests = blocks.filter("kind = 1").select("block", "group", "blob")

    @given_back
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        # contexts are those of all requests, also where only held-out documents have them
        found, pending, contexts = [], 0, []
        for blob in pdf["blob"]:
            w, u, c, own = decoded_pairs(pickle.loads(blob))
            contexts.append(own)
            found.append((w[c > 0], own[u[c > 0]], c[c > 0]))
            pending += len(w)
            if pending > 1 << 20:
                found, contexts = [added(*map(np.concatenate, zip(*found)))], [np.unique(np.concatenate(contexts))]
                pending = -len(found[0][0])
        pairs = added(*map(np.concatenate, zip(*found)))
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "blob": [pickle.dumps(coded_pairs(*pairs, np.unique(np.concatenate(contexts))))]})

    counts = bucketed(requests.groupBy("group").applyInPandas(count, "group int, blob binary"), "counts", "group")

    def seated(model: pd.DataFrame, replies: pd.DataFrame) -> tuple[Seating, list[Totals], np.ndarray]:
        """A group's words before the first sweep, the totals up to now, and its contexts."""
        w, u, c, contexts = decoded_pairs(pickle.loads(model["blob"].iloc[0]))
        history, customers = [], None
        for _, rows in replies.sort_values(["sweep", "part"]).groupby("sweep"):
            numbers, *parts = map(pickle.loads, rows["blob"])
            sums = [np.concatenate([unpacked(x) for x in column]).astype(float) for column in zip(*parts)]
            customers = sums[1] if customers is None else customers
            history.append(totals_of(np.concatenate([customers, sums[0], numbers]), len(contexts), history[0].discounts if history else None))
        return Seating(w, u, c, len(contexts), int(model["group"].iloc[0])), history, contexts

    @given_back
    def send(model: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """What the group has after the sweeps that the replies cover: single numbers to part -1, tables per context
        to the contexts' parts, at first with the customers."""
        own, history, contexts = seated(model, replies)
        for number, before in enumerate(history, 1):
            own.sweep(number, before)
        figures, k = own.figures(), len(contexts)
        part = group_of(contexts, groups)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [k]])
        rows = [(-1, pickle.dumps(figures[2 * k:]))]
        for a, b in zip(cuts, cuts[1:]):
            sums = [figures[k + a:k + b]] + ([] if history else [figures[a:b]])
            rows.append((int(part[a]), pickle.dumps((coded_hashes(contexts[a:b]), [packed(x.astype(np.uint32)) for x in sums]))))
        return pd.DataFrame(rows, columns=["part", "blob"]).assign(group=own.seed)[["part", "group", "blob"]]

    @given_back
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over all groups, to each group in the order of its contexts."""
        part, sent = int(pdf["part"].iloc[0]), [pickle.loads(b) for b in pdf["blob"]]
        if part < 0:
            out = [pickle.dumps(sum(sent))] * len(sent)
        else:
            contexts = [decoded_hashes(x) for x, _ in sent]
            distinct, place = np.unique(np.concatenate(contexts), return_inverse=True)
            cuts = np.cumsum([len(x) for x in contexts])[:-1]
            columns = []
            for column in zip(*(x for _, x in sent)):
                sums = np.bincount(place, np.concatenate([unpacked(x) for x in column]), len(distinct)).astype(np.uint64)
                columns.append([packed(x) for x in np.split(sums[place], cuts)])
            out = [pickle.dumps(x) for x in zip(*columns)]
        return pd.DataFrame({"group": pdf["group"], "part": part, "blob": out})

    # replies of part -1 come first; a group's contexts are sorted, so its parts in a row are its contexts
    replies = docs.sparkSession.createDataFrame([], "group int, part int, blob binary, sweep int")
    for number in range(sweeps + 1):
        messages = counts.groupBy("group").cogroup(replies.groupBy("group")).applyInPandas(send, "part int, group int, blob binary")
        now = stored(messages.groupBy("part").applyInPandas(add, "group int, part int, blob binary").withColumn("sweep", F.lit(number)), "totals")
        replies = replies.unionByName(now)
    single = replies.filter("part = -1 and sweep = 0").select("blob").first()
    start = totals_of(pickle.loads(single[0]) if single else np.zeros(NUMBERS), 0)

    @given_back
    def answer(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own, history, contexts = seated(told[told["sweep"] < 0], told[told["sweep"] >= 0])

        def read():
            for blob in asked["blob"]:
                w, u, _, some = decoded_pairs(pickle.loads(blob))
                yield w, np.searchsorted(contexts, some)[u]

        out = [pickle.dumps((packed(p), packed(c))) for p, c in answers(own, history, read(), burn_in)]
        return pd.DataFrame({"block": asked["block"], "group": asked["group"], "blob": out})

    @given_back
    def total(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        ids, held, sizes, steps = pickle.loads(pdf["blob"].iloc[0])
        parts = [pickle.loads(b) for b in replies.sort_values("group")["blob"]]
        logs = np.concatenate([unpacked(p) for p, _ in parts]).astype(np.float64)
        c = np.concatenate([unpacked(x) for _, x in parts]).astype(np.float64)
        base = np.log10((c + 0.1) / (start.tokens + 0.1 * (start.vocabulary + 1)))
        sizes = sizes.astype(np.int64)
        first = np.cumsum(sizes) - sizes
        run = np.cumsum(unpacked(steps).astype(np.int64))
        # differences begin anew with each document
        places = run - np.repeat(np.where(first > 0, run[first - 1], 0), sizes)
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": np.add.reduceat((c > 0)[places].astype(np.int64), first),
                             "train_tokens": start.tokens, "base_score": np.add.reduceat(base[places], first), "score": np.add.reduceat(logs[places], first)})

    # the requests stay where they are; counts come with the replies
    told = replies.unionByName(counts.select("group", "blob", F.lit(-1).alias("part"), F.lit(-1).alias("sweep")))
    answered = requests.groupBy("group").cogroup(told.groupBy("group")).applyInPandas(answer, "block long, group int, blob binary")
    heads = blocks.filter("kind = 0").select("block", "blob")
    return heads.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(
        total, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
