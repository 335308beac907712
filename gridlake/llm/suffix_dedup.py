"""Exact substring deduplication by a common-prefix-aware distributed merge sort of suffixes.

Sorting every suffix to the depth of `length` bytes would move some `length` times the corpus.
Two steps keep the sort small and exact:

* Suffixes are sorted at anchors only. An anchor is the first least hash of the byte grams in
  some window of `length` bytes, so equal windows have equal anchors at equal places. Anchors
  are some 2 in (length - gram) positions.
* Distinguishing prefixes: an anchor whose gram occurs once in the corpus needs no further
  byte and is not sent. Grams are counted by hash first.

What remains are the suffixes at repeated anchors, with the bytes to their left. Each task sorts its own
into runs and front-codes them (common prefix with the entry before, and the rest), equal
entries once. Runs are exchanged by gram and merged by loser trees which carry the common
prefix with the last winner, so known prefixes are never compared again. The merged order and its common prefixes
say which windows around each anchor occur twice; their bytes are removed."""
from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import _POWERS, given_back, mixed, prefix_sums, small_batches, stored, text_or_empty

LENGTH, GRAM = 200, 40
#: Suffixes that a task sorts into one run at most.
RUN_SUFFIXES = 100_000
#: Anchors of the corpus per merge group, about; a constant.
GROUP_ANCHORS = 100_000
_PLACE = np.uint64((1 << 31) - 1)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all windows of `length` bytes.

    Hashes are compared by their upper 33 bits, ties by place: both depend on the window alone."""
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = prefix_sums(data)
    _, down = _POWERS.upto(n + 1)
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    w = length - gram + 1
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max)
    padded[:len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - length + 1], ahead[w - 1:w - 1 + n - length + 1])
    # neighbours repeat, and a place never returns after another took over
    places = least[np.concatenate([[True], least[1:] != least[:-1]])] & _PLACE
    places = np.unique(places.astype(np.int64))
    return places, hashes[places]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, the first `known` bytes of which are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_coded(suffixes: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes to the left in reverse, key, place): common prefixes and rests, equal entries once."""
    suffixes.sort()
    shared, rests, lefts, counts, keys, places = [], [], [], [], [], []
    last = (b"", None)
    for right, left, key, place in suffixes:
        if (right, left) != last:
            known = common_prefix(last[0], right, 0)
            shared.append(known)
            rests.append(right[known:])
            lefts.append(left)
            counts.append(0)
            last = (right, left)
        counts[-1] += 1
        keys.append(key)
        places.append(place)
    return zlib.compress(pickle.dumps((
        np.array(shared, "<u4"), np.array([len(r) for r in rests], "<u4"), b"".join(rests), np.array([len(x) for x in lefts], "<u4"),
        b"".join(lefts), np.array(counts, "<u4"), np.array(keys, "<i8"), np.array(places, "<i4"))), 1)


class Run:
    """Reads a front-coded run from its first entry to its last."""

    def __init__(self, blob: bytes):
        self.shared, sizes, self.rests, left_sizes, self.lefts, self.counts, self.keys, self.places = pickle.loads(zlib.decompress(blob))
        self.ends, self.left_ends = np.cumsum(sizes).tolist(), np.cumsum(left_sizes).tolist()
        self.shared, self.n, self.at, self.suffix = self.shared.tolist(), len(self.shared), -1, b""

    def advance(self) -> int:
        """Moves on and returns the common prefix with the entry before, -1 past the last."""
        self.at += 1
        if self.at == self.n:
            self.suffix = b""
            return -1
        known = self.shared[self.at]
        self.suffix = self.suffix[:known] + self.rests[self.ends[self.at - 1] if self.at else 0:self.ends[self.at]]
        return known

    def left(self, k: int) -> bytes:
        return self.lefts[self.left_ends[k - 1] if k else 0:self.left_ends[k]]


def merged(runs: list[Run]):
    """Yields (run, entry, common prefix with the suffix before) of all runs in order.

    A loser tree: every inner node keeps the run that lost there and its common prefix with the
    winner. Of two suffixes not below the last winner the one that shares more with it is the
    smaller; only if both share the same length are bytes compared, from that length on."""
    width = 1
    while width < len(runs):
        width *= 2
    known = [run.advance() for run in runs] + [-1] * (width - len(runs))
    known = [0 if k >= 0 else -1 for k in known]
    loser = [0] * width

    def match(a, b):
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = runs[a].suffix, runs[b].suffix
        m = common_prefix(x, y, ka)
        if m == len(x):
            smaller = m < len(y) or a < b
        else:
            smaller = m < len(y) and x[m] < y[m]
        if smaller:
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    def build(node):
        if node >= width:
            return node - width
        winner, loser[node] = match(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if width > 1 else 0
    while known[winner] >= 0:
        yield winner, runs[winner].at, known[winner]
        known[winner] = runs[winner].advance()
        node = (winner + width) // 2
        while node:
            winner, loser[node] = match(winner, loser[node])
            node //= 2


def repeated_windows(shared: np.ndarray, sizes: np.ndarray, lefts: list[bytes], counts: np.ndarray, length: int, gram: int):
    """(least, most) distance from window start to anchor over the windows of each entry that occur twice; -1 for none.

    Entries are in suffix order; shared[i] is the common prefix with entry i - 1. The window that
    starts d bytes before the anchor is told by the suffix's first length - d bytes (an interval of the
    order) and by d bytes to the left (a rolling hash)."""
    n, reach = len(sizes), length - gram
    left_sizes = np.array([len(x) for x in lefts], np.int64)
    table = np.zeros((n, reach), np.uint8)
    raw = np.frombuffer(b"".join(lefts), np.uint8)
    row = np.repeat(np.arange(n), left_sizes)
    table[row, np.arange(len(raw)) - np.repeat(np.cumsum(left_sizes) - left_sizes, left_sizes)] = raw
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    rolled = np.zeros(n, np.uint64)
    for d in range(reach + 1):
        if d:
            rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + table[:, d - 1].astype(np.uint64) + np.uint64(1))
        there = np.flatnonzero((left_sizes >= d) & (sizes >= length - d))
        if not len(there):
            continue
        interval = np.cumsum(shared < length - d)[there].astype(np.uint64)
        _, where = np.unique(mixed(interval * np.uint64(0xD6E8FEB86659FD93)) ^ rolled[there], return_inverse=True)
        twice = there[np.bincount(where, counts[there])[where] > 1]
        least[twice] = np.where(least[twice] < 0, d, least[twice])
        most[twice] = d
    return least, most


def merge_group(blobs: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, begin, end) of byte ranges that repeated windows around the group's anchors cover."""
    runs = [Run(b) for b in blobs]
    shared, sizes, lefts, counts, origins = [], [], [], [], []
    for run, entry, known in merged(runs):
        shared.append(known)
        sizes.append(len(runs[run].suffix))
        lefts.append(runs[run].left(entry))
        counts.append(runs[run].counts[entry])
        origins.append((run, entry))
    least, most = repeated_windows(np.array(shared), np.array(sizes), lefts, np.array(counts, np.int64), length, gram)
    bounds = [np.concatenate([[0], np.cumsum(run.counts, dtype=np.int64)]) for run in runs]
    out = []
    for k in np.flatnonzero(least >= 0):
        run, entry = origins[k]
        own = slice(bounds[run][entry], bounds[run][entry + 1])
        places = runs[run].places[own].astype(np.int64)
        out.append((runs[run].keys[own], places - most[k], places + length - least[k]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def kept_bytes(data: bytes, ranges) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the data and the maximal removed spans."""
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), [(a, b) for a, b in spans]


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All rows and columns of `docs` with n_bytes, kept (binary) and removed (array of begin, end).

    Every byte goes that is covered by a string of `length` bytes which also starts anywhere
    else in the corpus, the same text included; texts are UTF-8, null is empty, shorter texts
    stay whole. Strings are judged on the input. Rows that repeat an id are told apart by
    their text; fully repeated rows repeat each other. `docs` is read three times. Columns
    of the result's names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "kept", "removed", "_key", "_places", "_ranges")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", text_or_empty()))
    texts = keyed.select("_key", text_or_empty().alias("t"))

    @given_back
    def find(batches):
        for batch in batches:
            keys, places, hashes = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, h = anchors(t.encode("utf-8", "surrogatepass"), length, gram)
                keys.append(np.full(len(p), key, np.int64))
                places.append(p.astype(np.int32))
                hashes.append(h.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, hashes)], ["_key", "place", "hash"])

    found = stored(texts.mapInArrow(find, "_key long, place int, hash long"), "anchors")
    groups = max(1, -(-found.count() // GROUP_ANCHORS))
    twice = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    hits = stored(found.join(twice, "hash").groupBy("_key").agg(F.collect_set("place").alias("_places")), "hits")

    @given_back
    def sort(batches):
        held, n = {}, 0
        for batch in batches:
            for key, t, places in zip(*(batch.column(c).to_pylist() for c in range(3))):
                data = t.encode("utf-8", "surrogatepass")
                for p in places:
                    right = data[p:p + length]
                    held.setdefault(zlib.crc32(right[:gram]) % groups, []).append((right, data[max(0, p - length + gram):p][::-1], key, p))
                n += len(places)
                if n >= RUN_SUFFIXES:
                    for g in sorted(held):
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([front_coded(held.pop(g))], pa.binary())], ["group", "run"])
                    n = 0
        for g in sorted(held):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([front_coded(held.pop(g))], pa.binary())], ["group", "run"])

    @given_back
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        key, begin, end = merge_group(pdf["run"].tolist(), length, gram)
        return pd.DataFrame({"_key": key, "begin": begin.astype("int32"), "end": end.astype("int32")})

    runs = texts.join(hits, "_key").select("_key", "t", "_places").mapInArrow(sort, "group int, run binary")
    ranges = runs.groupBy("group").applyInPandas(merge, "_key long, begin int, end int")
    ranges = stored(ranges.groupBy("_key").agg(F.collect_list(F.struct("begin", "end")).alias("_ranges")), "ranges")
    rows = keyed.join(ranges, "_key", "left").drop("_key")
    names = rows.columns
    at, last = names.index("text"), names.index("_ranges")
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    @given_back
    def cut(batches):
        for batch in batches:
            sizes, kept, removed = [], [], []
            for t, found in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                rest, spans = kept_bytes(data, [(x["begin"], x["end"]) for x in found or ()])
                sizes.append(len(data))
                kept.append(rest)
                removed.append([{"begin": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != last), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                                              pa.array(removed, span)], [*(x for x in names if x != "_ranges"), "n_bytes", "kept", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(cut, f"{schema}, n_bytes long, kept binary, removed array<struct<begin: int, end: int>>")
