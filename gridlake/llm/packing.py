"""Packing by lexical retrieval: a sharded BM25 inverted index names unused neighbours that fill each seed's window.

The longest documents, as many as there are windows to begin, are the seeds of the corpus. Their index is kept in blocks
of seeds that are alike. Every document queries, with all its terms, the blocks that promise most, whose number grows as
the logarithm of the number of blocks, and is linked to the other seed that scores best. What links connect is packed by
one task; only what exceeds a task is split."""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import compress, decompress

from gridlake.llm.blocks import by_part, compressed, joined, sections, split
from gridlake.llm.bpe import encoded, vocabulary
from gridlake.llm.shared import given_back, stored

WINDOW, END_ID = 4096, 2
#: Tokens of a packing shard, about; a constant, so that a shard fits a task at every size of the corpus.
SHARD_TOKENS = 1_000_000
#: Seeds of a block of their index, about, and how many of them and of the documents that ask it a task holds at once, about; constants.
BLOCK_SEEDS, SEED_PIECE, QUERY_PIECE = 1024, 4096, 32768
#: Documents whose beginnings say which ids are common and get short codes, at most.
CODED = 500
#: Seeds that tell the blocks apart, at most, and how many of them are one leaf; terms with a place of their own there, and places of the others.
SAMPLE, LEAF_SEEDS, ROUTE_TERMS, ROUTE_SHARED = 4096, 4, 1024, 256
#: Terms of a block whose weights are kept as a matrix, at most, and steps of a weight.
DENSE_TERMS, STEPS = 1024, 256
K1, B = 1.2, 0.75


class Coder:
    """Ids of a document in few bytes: one byte for each of 255 ids, the others at the end, then zstd. `common` says which
    ids are common; that changes lengths only."""

    def __init__(self, common: np.ndarray, vocabulary_size: int):
        counts = np.bincount(common, minlength=vocabulary_size)
        self.ids = np.argsort(-counts, kind="stable").astype("<u4")
        self.rank = np.empty(len(self.ids), "<u4")
        self.rank[self.ids] = np.arange(len(self.ids))
        self.wide = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def coded(self, ids: np.ndarray) -> bytes:
        rank = self.rank[ids]
        return compress(len(ids).to_bytes(4, "little") + np.minimum(rank, 255).astype(np.uint8).tobytes() + rank[rank >= 255].astype(self.wide).tobytes(), 1)

    def decoded(self, data) -> np.ndarray:
        data = decompress(data)
        n = int.from_bytes(data[:4], "little")
        rank = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
        rank[rank == 255] = np.frombuffer(data, self.wide, -1, 4 + n)
        return self.ids[rank]


def document_frequencies(tokens: DataFrame, vocabulary_size: int, coder: Coder) -> tuple[np.ndarray, int, int]:
    """In how many documents each token id occurs, the number of documents and of tokens.

    A task sends one vector of the vocabulary's length, and Spark adds them up by ranges of
    ids, so what reaches the driver is bounded by the vocabulary."""
    @given_back
    def run(batches):
        counts, docs, total = np.zeros(vocabulary_size, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column(0):
                ids = coder.decoded(ids.as_buffer())
                counts[np.unique(ids)] += 1
                docs, total = docs + 1, total + len(ids)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, [-1, -2]]), pa.int64()),
                                          pa.array(np.concatenate([counts[found], [docs, total]]), pa.int64())], ["token", "n"])

    out, totals = np.zeros(vocabulary_size, np.int64), {-1: 0, -2: 0}
    for token, n in tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        if token < 0:
            totals[token] = n
        else:
            out[token] = n
    return out, totals[-1], totals[-2]


class Index:
    """BM25 inverted index of the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        counted = [np.unique(d, return_counts=True) for d in docs]
        term = np.concatenate([c[0] for c in counted])
        doc = np.repeat(np.arange(len(docs)), [len(c[0]) for c in counted])
        tf = np.concatenate([c[1] for c in counted]).astype(np.float32)
        length = np.array([len(d) for d in docs], np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_length, 1.0)))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order].astype(np.int32), weight[order].astype(np.float32)
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
        bounds = np.concatenate([[0], np.cumsum([len(c[0]) for c in counted])])
        self.own = [term[a:b] for a, b in zip(bounds, bounds[1:])]
        self.n = len(docs)

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents that share a term with the seed, best first by the sum over all its terms; ties by position."""
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in self.own[seed]]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW):
    """Yields (document, start, length, sequence, offset); every token in one piece, sequences filled without gaps.

    The longest unused document is the seed of a window; its unused neighbours follow in
    order of their scores until the window is full, then unused documents in order. The document
    that crosses the border is cut, and its rest begins the next window as that one's seed. What
    is left at the end is cut at powers of two, which need no padding."""
    index = Index(docs, idf, mean_length)
    used = np.zeros(len(docs), bool)
    by_length = sorted(range(len(docs)), key=lambda k: (-len(docs[k]), k))
    total, at, sequence, room, offset = sum(map(len, docs)), 0, 0, 0, 0
    left = total

    def next_size(left):
        return window if left >= window else 1 << (left.bit_length() - 1)

    order, queue = iter(by_length), iter(())
    seed, start = None, 0
    if left:
        room = next_size(left)
    while left:
        if seed is None:
            seed = next((k for k in queue if not used[k]), None)
            if seed is None:
                seed = next(k for k in order if not used[k])
                queue = iter(index.neighbours(seed))
            used[seed], start = True, 0
        take = min(room, len(docs[seed]) - start)
        if take:
            yield seed, start, take, sequence, offset
        start, offset, room, left = start + take, offset + take, room - take, left - take
        done = start == len(docs[seed])
        if room == 0 and left:
            sequence, offset, room = sequence + 1, 0, next_size(left)
            queue = iter(()) if done else iter(index.neighbours(seed))
        if done:
            seed = None


def weighed(doc: np.ndarray, idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a document and their BM25 weights in whole steps."""
    term, tf = np.unique(doc, return_counts=True)
    tf, length = tf.astype(np.float32), np.float32(len(doc))
    return term, np.rint(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1.0))) * STEPS).astype(np.float32)


class Seeds:
    """BM25 index of a block of the seeds; weights are whole steps, so that sums do not depend on their order."""

    def __init__(self, keys: list[int], docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.build(keys, keys, *zip(*(weighed(d, idf, mean_length) for d in docs)), len(idf))

    @classmethod
    def of(cls, keys, others, terms: list[np.ndarray], weights: list[np.ndarray], n_terms: int) -> Seeds:
        """From weighed documents. Copies are one entry; `others` has another copy's key, or the entry's own."""
        out = cls.__new__(cls)
        out.build(keys, others, terms, weights, n_terms)
        return out

    def build(self, keys, others, terms, weights, n_terms):
        self.keys, self.others = np.array(keys, np.int64), np.array(others, np.int64)
        self.place = {int(key): at for at, key in enumerate(keys) if others[at] == key}      # of those without a copy
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        docs, weights = np.repeat(np.arange(len(keys)), [len(t) for t in terms])[order], np.concatenate(weights)[order].astype(np.float32)
        term = term[order].astype(np.int64)
        df = np.bincount(term, minlength=n_terms)
        dense = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        dense = dense[df[dense] > len(keys) // 32]
        self.row = np.full(len(df), -1, np.int32)        # of a term in the matrix
        self.row[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), len(keys)), np.float32)
        own = self.row[term] >= 0
        self.matrix[self.row[term[own]], docs[own]] = weights[own]
        self.docs, self.weights = docs[~own], weights[~own]
        self.begin = np.concatenate([[0], np.cumsum(np.where(self.row >= 0, 0, df))])

    def best(self, docs: list[np.ndarray], keys: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place and score of the best seed of each document but itself, over all its terms; ties to the first."""
        return self.best_of([np.unique(d) for d in docs], keys)

    def best_of(self, terms: list[np.ndarray], keys: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        flat, query = np.concatenate(terms).astype(np.int64), np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        row = self.row[flat]
        own = row >= 0
        asked = np.zeros((len(terms), len(self.matrix)), np.float32)
        asked[query[own], row[own]] = 1
        scores = asked @ self.matrix
        flat, query = flat[~own], query[~own]
        count = self.begin[flat + 1] - self.begin[flat]
        if count.any():
            at = np.repeat(self.begin[flat] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            scores += np.bincount(np.repeat(query, count) * len(self.keys) + self.docs[at], self.weights[at], scores.size).reshape(scores.shape)
        for k, key in enumerate(keys or ()):
            if key in self.place:
                scores[k, self.place[key]] = 0
        at = scores.argmax(axis=1)
        return at, scores[np.arange(len(terms)), at]


def leaves(rows: np.ndarray, most: int, rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
    """(mean, number of rows) of the leaves of a tree of k-means, in its order; rows that nothing tells apart are one leaf."""
    if len(rows) > most:
        means = rows[rng.choice(len(rows), min(8, max(2, -(-len(rows) // most))), replace=False)]
        for _ in range(5):
            own = (rows @ means.T - 0.5 * (means * means).sum(axis=1)).argmax(axis=1)
            for c in np.unique(own):
                means[c] = rows[own == c].mean(axis=0)
        found = np.unique(own)
        if len(found) > 1:
            return [leaf for c in found for leaf in leaves(rows[own == c], most, rng)]
    return [(rows.mean(axis=0), len(rows))]


class Router:
    """Names the blocks of the index of seeds that a document asks, and the one that keeps it if it is a seed.

    Fitted on a bounded sample of the seeds: the leaves of its tree, in order, fill the blocks. A document asks the blocks
    of the leaves that score best, 1.5 times the logarithm of their number, and those of the leaves nearest to it, where
    its own near copies are. The commonest terms have a place each, all others share some by a hash."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], n_seeds: int, df: np.ndarray, idf: np.ndarray):
        self.row = (ROUTE_TERMS + np.arange(len(df)) * 40503 % ROUTE_SHARED).astype(np.int64)
        self.row[np.argsort(-(df * idf.astype(np.float64) ** 2), kind="stable")[:ROUTE_TERMS]] = np.arange(min(ROUTE_TERMS, len(df)))
        found = leaves(self.rows(*zip(*sample))[1], LEAF_SEEDS, np.random.default_rng(0))
        self.means = np.rint([mean for mean, _ in found]).astype(np.float32).T.copy()
        self.half = 0.5 * (self.means * self.means).sum(axis=0)
        block, filled, self.block = 0, 0.0, []
        for _, n in found:
            n *= n_seeds / len(sample)
            if filled and filled + n > BLOCK_SEEDS:
                block, filled = block + 1, 0.0
            self.block.append(block)
            filled += n
        self.block = np.array(self.block)
        self.begin = np.searchsorted(self.block, np.arange(block + 1))
        self.most = min(block + 1, max(4, 3 * block.bit_length() // 2))
        self.cuts = np.maximum(1, np.rint(np.bincount(self.block, [n for _, n in found]) * n_seeds / len(sample) / SEED_PIECE).astype(np.int64))
        self.deal(np.zeros(block + 1))

    def deal(self, asked: np.ndarray) -> None:
        """Groups of a block, for the number of documents that ask it: every part of these meets every cut of its seeds."""
        self.parts = np.maximum(1, -(-asked // QUERY_PIECE)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts * self.cuts)])

    def groups(self, keys: np.ndarray, blocks: np.ndarray, seeds: bool) -> tuple[np.ndarray, np.ndarray]:
        """(position in keys, group) of the groups in which documents ask these blocks, or seeds are kept in them."""
        split, meets = (self.cuts, self.parts) if seeds else (self.parts, self.cuts)
        own = (keys.view(np.uint64) >> np.uint64(20)).astype(np.int64) % split[blocks]
        at = np.repeat(np.arange(len(keys)), meets[blocks])
        other = np.arange(len(at)) - np.repeat(np.cumsum(meets[blocks]) - meets[blocks], meets[blocks])
        part, cut = (other, own[at]) if seeds else (own[at], other)
        return at, self.first[blocks[at]] + part * self.cuts[blocks[at]] + cut

    def rows(self, terms, weights) -> tuple[np.ndarray, np.ndarray]:
        """The documents' terms and their weights in the router's places; whole numbers, so that sums are exact."""
        at = np.repeat(np.arange(len(terms)), [len(t) for t in terms]) * (ROUTE_TERMS + ROUTE_SHARED) + self.row[np.concatenate(terms)]
        shape = len(terms), ROUTE_TERMS + ROUTE_SHARED
        return (np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape).astype(np.float32),
                np.bincount(at, np.rint(np.concatenate(weights) / 16), shape[0] * shape[1]).reshape(shape).astype(np.float32))

    def blocks(self, terms, weights) -> tuple[list[list[int]], list[int]]:
        asked, rows = self.rows(terms, weights)
        best = np.argsort(-np.maximum.reduceat(asked @ self.means, self.begin, axis=1), axis=1, kind="stable")[:, :self.most]
        scores = rows @ self.means - self.half
        first = scores.argmax(axis=1)
        scores[np.arange(len(terms)), first] = -np.inf
        near, next_ = self.block[first], self.block[scores.argmax(axis=1)]
        return [sorted({*b, x, y}) for b, x, y in zip(best.tolist(), near.tolist(), next_.tolist())], near.tolist()


def packed_terms(terms: np.ndarray, kind: str) -> bytes:
    """Ascending term ids as planes of the bytes of their steps, of which all but the first are nearly empty."""
    return np.diff(terms.astype(np.int64), prepend=0).astype(kind).view(np.uint8).reshape(-1, int(kind[2:])).T.tobytes()


def unpacked_terms(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(int(kind[2:]), -1).T).view(kind).ravel(), dtype=np.int64)


def best_seeds(tokens: DataFrame, n_seeds: int, n_docs: int, df: np.ndarray, idf: np.ndarray, mean_length: float, coder: Coder) -> DataFrame:
    """Rows (key, seed): the other seed that scores best for each key, of all seeds in the blocks that it asks.

    Keys that share no weighty term with any are left out. Seeds and the documents that ask them meet in groups of a
    bounded size; only distinct terms travel, those of many documents in a row."""
    n_terms, kind = len(idf), coder.wide

    def weighed_rows(batch):
        return zip(*(weighed(coder.decoded(x.as_buffer()), idf, mean_length) for x in batch.column("ids")))

    @given_back
    def weigh(batches):
        for batch in batches:
            if batch.num_rows:
                terms, weights = weighed_rows(batch)
                yield pa.RecordBatch.from_arrays([batch.column("is_seed"), pa.array([packed_terms(t, kind) for t in terms], pa.binary()), pa.array([w.astype("<u2").tobytes() for w in weights], pa.binary())], ["is_seed", "terms", "weights"])

    def sample(rows: DataFrame, n: int, most: int):
        own = rows.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 20)) < int(np.ceil(min(1, most / n) * (1 << 20)))).dropDuplicates(["key"])
        found = sorted((bytes(t), bytes(w)) for _, t, w in own.select("is_seed", "ids").mapInArrow(weigh, "is_seed boolean, terms binary, weights binary").collect())
        return [(unpacked_terms(t, kind), np.frombuffer(w, "<u2")) for t, w in found]

    seeds = sample(tokens.filter("is_seed"), n_seeds, max(min(SAMPLE, n_seeds // 32), 256))
    if not seeds:
        return tokens.sparkSession.createDataFrame([], "key long, seed long")
    router = Router(seeds, n_seeds, df, idf)
    asking = sample(tokens, n_docs, SAMPLE)
    counts = np.zeros(len(router.cuts))
    for k in range(0, len(asking), 256):
        blocks, _ = router.blocks(*zip(*asking[k:k + 256]))
        counts += np.bincount(np.concatenate(blocks), minlength=len(counts))
    router.deal(counts * n_docs / max(len(asking), 1))
    shared = tokens.sparkSession.sparkContext.broadcast(router)

    @given_back
    def route(batches):
        router = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, (terms, weights) = batch.column("key").to_numpy(), weighed_rows(batch)
            blocks, own = [], []
            for k in range(0, len(keys), 256):
                asked, kept = router.blocks(terms[k:k + 256], weights[k:k + 256])
                blocks += asked
                own += kept
            packed_rows = [packed_terms(t, kind) for t in terms]
            out = {"group": [], "seeds": [], "data": []}
            seeds = np.flatnonzero(batch.column("is_seed").to_numpy(zero_copy_only=False))
            for is_seed, place, block in ((False, np.repeat(np.arange(len(keys)), [len(x) for x in blocks]), np.concatenate(blocks)), (True, seeds, np.array(own)[seeds])):
                at, group = router.groups(keys[place], block, is_seed)
                for rows in by_part(group):
                    docs = place[at[rows]]
                    parts = [keys[docs].astype("<i8").tobytes(), joined([packed_rows[d] for d in docs])]
                    out["group"].append(int(group[rows[0]]))
                    out["seeds"].append(is_seed)
                    out["data"].append(compressed(*parts, *([joined([weights[d].astype("<u2").tobytes() for d in docs])] if is_seed else [])))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("group", pa.int64()), ("seeds", pa.bool_()), ("data", pa.binary())]))

    @given_back
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        entries = {}        # copies are one entry: the greatest key and the least
        for data in rows["data"][rows["seeds"]]:
            keys, terms, weights = sections(data)
            for key, *entry in zip(np.frombuffer(keys, "<i8").tolist(), split(terms), split(weights)):
                most, least = entries.get(tuple(entry), (key, key))
                entries[tuple(entry)] = max(most, key), min(least, key)
        out = []
        if entries:
            order = sorted(entries, key=lambda x: -entries[x][0])      # equal scores go to the greatest key
            index = Seeds.of([entries[x][0] for x in order], [entries[x][1] for x in order], [unpacked_terms(x[0], kind) for x in order], [np.frombuffer(x[1], "<u2") for x in order], n_terms)
            asked, kept = [], []
            queries = rows["data"][~rows["seeds"]].tolist()
            for k, data in enumerate(queries):
                keys, terms = sections(data)
                kept += split(terms)
                asked.append(np.frombuffer(keys, "<i8"))
                if len(kept) >= 256 or k + 1 == len(queries):
                    keys = np.concatenate(asked)
                    for a in range(0, len(keys), 512):
                        own = keys[a:a + 512]
                        at, score = index.best_of([unpacked_terms(x, kind) for x in kept[a:a + 512]], own.tolist())
                        seed = np.where(index.keys[at] == own, index.others[at], index.keys[at])
                        out.append(pd.DataFrame({"key": own, "seed": seed, "score": score.astype(np.float64)})[score > 0])
                    asked, kept = [], []
        return pd.concat(out) if out else pd.DataFrame({"key": [], "seed": [], "score": []})

    found = tokens.select("key", "is_seed", "ids").mapInArrow(route, "group long, seeds boolean, data binary").groupBy("group").applyInPandas(search, "key long, seed long, score double")
    return found.groupBy("key").agg(F.max_by("seed", F.struct("score", "seed")).alias("seed"))


def seed_bounds(lengths: list[tuple[int, int]], window: int) -> tuple[int, float]:
    """(length, share): documents longer than `length` and this share of those of it are seeds.

    `lengths` are lengths and their counts. The windows that the seeds begin hold the whole corpus, about."""
    left = sum(n * count for n, count in lengths)
    for n, count in sorted(lengths, reverse=True):
        need = -(-n // window) * window
        if need * count > left:
            return n, left / (need * count)
        left -= need * count
    return 0, 1.0


def shards_of(keys: np.ndarray, sizes: np.ndarray, links: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each group and the number of pieces it is cut into, from the link of its seed to the seed nearest to it.

    Links make trees, which are gathered from the leaves up to two shards each. A seed that has more
    near ones than that keeps the smallest, and the others stay together as far as they fit. Trees fill
    shards in turn. Only a group that is itself larger is cut."""
    n, cap = len(keys), 2 * shard_tokens
    order = np.argsort(keys, kind="stable")
    at = order[np.minimum(np.searchsorted(keys[order], links), max(n - 1, 0))]
    parent = np.where((keys[at] == links) & (at != np.arange(n)), at, -1).tolist()
    waits = np.bincount([x for x in parent if x >= 0], minlength=n).tolist()
    ready, done, walk, rest = [k for k in order.tolist() if not waits[k]], [False] * n, [], iter(order.tolist())
    while len(walk) < n:
        if not ready:       # only rings are left: one is opened
            k = next(k for k in rest if not done[k] and parent[k] >= 0)
            top, parent[k] = parent[k], -1
        else:
            k = ready.pop()
            done[k] = True
            walk.append(k)
            top = parent[k]
        if top >= 0:
            waits[top] -= 1
            if not waits[top]:
                ready.append(top)
    head, size, near = list(range(n)), sizes.tolist(), [[] for _ in range(n)]
    for k in walk:
        bin_head, bin_size = None, 0
        for child in sorted(near[k], key=lambda c: (size[c], keys[c])):
            if size[k] + size[child] <= cap:
                head[child], size[k] = k, size[k] + size[child]
            elif bin_head is not None and size[bin_head] + size[child] <= cap:
                head[child], size[bin_head] = bin_head, size[bin_head] + size[child]
            else:
                bin_head = child
        near[k] = None
        if parent[k] >= 0 and size[k] <= cap:
            near[parent[k]].append(k)
    shard, number, filled = [-1] * n, 0, 0
    for k in order.tolist():
        if head[k] == k:
            if filled and filled + size[k] > shard_tokens:
                number, filled = number + 1, 0
            shard[k], filled = number, filled + size[k]
    for k in range(n):
        top = k
        while head[top] != top:
            top = head[top]
        shard[k] = shard[top]
    return np.array(shard, np.int64), np.where(sizes > cap, -(-sizes // shard_tokens), 1)


def grouped(tokens: DataFrame, df: np.ndarray, idf: np.ndarray, mean_length: float, total: int, window: int, shard_tokens: int, coder: Coder) -> DataFrame:
    """Adds the packing group, `shard` and `part`, to rows (id, ids, key, n).

    A document goes where its best seed goes, and seeds are gathered by shards_of on the driver,
    which holds three numbers per seed and so per window, about."""
    if total <= shard_tokens:
        return tokens.withColumn("shard", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long"))
    lengths = [tuple(r) for r in tokens.groupBy("n").count().collect()]
    least, share = seed_bounds(lengths, window)
    tokens = tokens.withColumn("is_seed", (F.col("n") > least) | ((F.col("n") == least) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))))
    n_seeds = max(1, sum(count if n > least else int(share * count) for n, count in lengths if n >= least))
    links = best_seeds(tokens, n_seeds, sum(count for _, count in lengths), df, idf, mean_length, coder)
    # a seed is of its own group, and so is a document that shares no weighty term with any seed
    placed = tokens.groupBy("key").agg(F.first("is_seed").alias("is_seed"), F.sum("n").alias("n"))
    placed = stored(placed.join(links, "key", "left").withColumn("group", F.when(F.col("is_seed"), F.col("key")).otherwise(F.coalesce("seed", "key"))), "placed")
    found = placed.groupBy("group").agg(F.sum("n").alias("n"), F.coalesce(F.max(F.when(F.col("key") == F.col("group"), F.col("seed"))), F.col("group")).alias("link")).toPandas()
    shard, pieces = shards_of(found["group"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["link"].to_numpy(np.int64), shard_tokens)
    homes = tokens.sparkSession.createDataFrame(pd.DataFrame({"group": found["group"].astype(np.int64), "shard": shard, "pieces": pieces}), "group long, shard long, pieces long")
    homes = placed.join(homes, "group").select("key", "shard", "pieces")
    return tokens.join(homes, "key").withColumn("part", F.pmod(F.xxhash64("key"), F.col("pieces")))


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), one per piece.

    `window` is a power of two. A document is its ids and the end id; null and empty texts
    are the end id alone. Repeated rows are packed each. Document frequencies cover the whole
    corpus. Documents share a shard with the seed, of those in the blocks that they ask, that is
    nearest to them; each shard is indexed once more and packed by one task."""
    path = path or vocabulary()
    from gridlake.llm.bpe import encoder
    size = max(len(encoder(path).strings), END_ID + 1)
    width = 2 if size <= 1 << 16 else 4      # what is stored and shuffled
    kind = f"<u{width}"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], kind)
    common = [np.frombuffer(r[0], kind) for r in encoded(docs.limit(CODED), path, width=width).select(F.substring("ids", 1, 4096 * width)).collect()]
    coder = Coder(np.concatenate([end, *common]), size)

    @given_back
    def code(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(x.as_buffer(), kind), end]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([coder.coded(x) for x in ids], pa.binary()), batch.column("key"), pa.array([len(x) for x in ids], pa.int64())], ["id", "ids", "key", "n"])

    tokens = encoded(docs, path, width=width).withColumn("key", F.xxhash64("id", "ids"))
    tokens = stored(tokens.mapInArrow(code, f"id {id_type}, ids binary, key long, n long"), "tokens")
    df, n, total = document_frequencies(tokens, size, coder)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = total / max(n, 1)

    @given_back
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"], kind="stable")
        own = [coder.decoded(x) for x in pdf["ids"]]
        names, base, out = pdf["id"].tolist(), (int(pdf["shard"].iloc[0]) << 20 | int(pdf["part"].iloc[0])) << 20, []
        for k, start, length, sequence, offset in pack_shard(own, idf, mean_length, window):
            piece = own[k][start:start + length].astype("<u4").tobytes()
            out.append((names[k], start, length, zlib.crc32(piece), len(own[k]), base + sequence, offset, piece))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    rows = grouped(tokens, df, idf, mean_length, total, window, shard_tokens, coder).select("id", "ids", "key", "shard", "part")
    return rows.groupBy("shard", "part").applyInPandas(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
