"""Trie of conversation prefixes by truncation peeling.

Conversations become paths of chained digests, one per prefix. Sorted by path, they are cut into
blocks; a block is peeled from its greatest depth: conversations that end there merge with the
nodes that survived from below, the last turn is stripped and what became equal is regrouped, so
every node is complete when it is found. Only prefixes of a block's first and last path can go
on in another block. These stay open, hold what their closed children brought, and are peeled
the same way over groups of neighbouring blocks until one group is left. A prefix of very many
conversations is so shared out over blocks like any other range of the order."""
from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.blocks import block_number
from gridlake.llm.shared import small_batches, stored

#: Conversations, and turns, after which a block ends.
BLOCK, BLOCK_TURNS = 50_000, 1_000_000
#: Ids joined in one row for a digest, and blocks peeled together in a round (a power of two's exponent).
CHUNK, ROUND_BITS = 50_000, 4
SALTS = 64
_KEY = 16
_NONE = np.iinfo(np.int64).max
_SCHEMA = ("kind string, block long, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, words long, first boolean, last boolean, part long, ids binary, ends_sha256 string")
_ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]])
                    for f in _SCHEMA.split(", ")])
_NO_ENDS = hashlib.sha256().hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, digest, words) of a table of turns; null role or text is empty, rows without conv_id belong to none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(F.sha2(content, 256), 1, 2 * _KEY)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _chained(batches):
    """Paths of the conversations of sorted turns; the first turns of a family's head replace as many of the others' own."""
    out, family, conv, path, words = [], None, None, bytearray(), array("q")

    def batch():
        rows = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["conv_id", "path", "words"])

    def add(digest, n):
        path.extend(hashlib.blake2b(path[-_KEY:] + digest, digest_size=_KEY).digest())
        words.append(n)

    for rows in batches:
        for base, c, h, digest, n in zip(*(x.to_pylist() for x in rows.columns)):
            if c != conv:
                if conv is not None:
                    out.append((conv, bytes(path), words.tobytes()))
                    if len(out) == 1000:
                        yield batch()
                if base != family:
                    family, head = base, []
                conv, at, path, words = c, 0, bytearray(), array("q")
                if c != base:
                    for turn in head[:h]:
                        add(*turn)
            if c == base and at < 3:
                head.append((digest, n))
            if c == base or at >= h:
                add(digest, n)
            at += 1
    if conv is not None:
        out.append((conv, bytes(path), words.tobytes()))
        yield batch()


def paths(conversations: DataFrame, family: int = 20) -> DataFrame:
    """Rows (conv_id, path, words): 16 bytes per prefix and the words of its last turn as 64-bit integers.

    Conversation c takes the first h turns of the head of its family, c - c % family, in place of
    its own first h, where h = crc32(c) % 4; family = 1 leaves conversations as they are. Turns are
    ordered by turn, null first, then by a digest of their content. A conversation is one row of 24
    bytes a turn; its texts are never gathered."""
    c = F.col("conv_id")
    base = c - c % family
    rows = turns(conversations).select(base.alias("base"), "conv_id", (F.crc32(c.cast("string")) % 4).alias("h"), "digest", "words", "turn")
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "digest")
    return rows.select("base", "conv_id", "h", "digest", "words").mapInArrow(_chained, "conv_id long, path binary, words binary")


def _rows(**columns) -> pa.RecordBatch:
    size = len(columns["kind"])

    def made(f):
        value = columns.get(f.name)
        return pa.nulls(size, f.type) if value is None else value if isinstance(value, pa.Array) else pa.array(value, f.type)

    return pa.RecordBatch.from_arrays([made(f) for f in _ARROW], schema=_ARROW)


def _joined(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


def _peel(block: int, chunk: int, convs: list[int], path: list[bytes], words: list[bytes]):
    """Nodes, open nodes and pieces of open ends of one block of sorted paths."""
    conv = np.array(convs, np.int64)
    depth = np.array([len(p) // _KEY for p in path])
    begin = np.concatenate([[0], np.cumsum(depth)])
    keys = np.frombuffer(b"".join(path), "<u8").reshape(-1, 2)
    count = np.frombuffer(b"".join(words), "<i8")
    ended_at = np.argsort(depth, kind="stable")
    ended_from = np.searchsorted(depth[ended_at], np.arange(depth.max() + 2))
    zero = np.zeros(0, np.int64)
    # surviving nodes, in order: their first and last row, and what they hold; open ones pass nothing up
    low, high, is_open, held = zero, zero, zero.astype(bool), {x: zero for x in ("n_convs", "n_children", "n_leaves", "saved_tokens", "conv_id")}
    waiting = None      # closed nodes of the level below, which lack the id of their parent

    def key_bytes(rows, d):
        at = begin[rows] + d - 1
        return [keys[i].tobytes() for i in at] if d else [b""] * len(rows)

    for d in range(int(depth.max()), -1, -1):
        new = np.sort(ended_at[ended_from[d]:ended_from[d + 1]])
        up = ~is_open
        every_low = np.concatenate([low, new])
        order = np.argsort(every_low, kind="stable")
        every_low = every_low[order]
        every_high = np.concatenate([high, new])[order]
        if d:
            here = keys[begin[every_low] + d - 1]
            starts = np.flatnonzero(np.concatenate([[True], (here[1:] != here[:-1]).any(axis=1)])) if len(here) else zero
        else:
            starts = np.zeros(1, np.int64)
        gone_up = {"n_convs": held["n_convs"], "n_children": np.ones(len(low), np.int64), "n_leaves": held["n_leaves"], "saved_tokens": held["saved_tokens"]}
        own = {"n_convs": np.ones(len(new), np.int64)}
        if len(starts):
            held = {x: np.add.reduceat(np.concatenate([np.where(up, v, 0), own.get(x, np.zeros(len(new), np.int64))])[order], starts) for x, v in gone_up.items()} | {
                "conv_id": np.minimum.reduceat(np.concatenate([np.where(up, held["conv_id"], _NONE), conv[new]])[order], starts)}
        group = np.empty(len(order), np.int64)
        group[order] = np.searchsorted(starts, np.arange(len(order)), side="right") - 1
        was_open, children_of = is_open, group[:len(low)]
        low, high = every_low[starts], np.maximum.reduceat(every_high, starts) if len(starts) else zero
        is_open = (low == 0) | (high == len(conv) - 1)
        own_words = count[begin[low] + d - 1] if d else np.zeros(len(low), np.int64)
        closed = ~is_open
        held["n_leaves"] = np.where(closed & (held["n_children"] == 0), 1, held["n_leaves"])
        held["saved_tokens"] = held["saved_tokens"] + np.where(closed, (held["n_convs"] - 1) * own_words, 0)
        if waiting is not None and len(waiting["depth"]):
            parent = children_of[~was_open]
            waiting["parent_conv_id"] = pa.array(held["conv_id"][parent], mask=is_open[parent])
            yield _rows(**waiting)
        # conversations that end here lie together in the order, least id first
        ends, own_group = {}, group[len(group) - len(new):]
        cuts = np.flatnonzero(np.diff(own_group, prepend=-1))
        for g, rows in zip(own_group[cuts].tolist(), np.split(new, cuts[1:]) if len(new) else []):
            ends[g] = conv[rows].tolist()
        names = key_bytes(low, d)
        parents = key_bytes(low, d - 1) if d else [None] * len(low)
        pick = np.flatnonzero(closed)
        waiting = {"kind": ["node"] * len(pick), "block": [block] * len(pick), "key": [names[g] for g in pick], "parent": [parents[g] for g in pick],
                   "depth": np.full(len(pick), d), **{x: held[x][pick] for x in held},
                   "ends_sha256": [hashlib.sha256(_joined(ends[g])).hexdigest() if g in ends else _NO_ENDS for g in pick.tolist()]}
        pick = np.flatnonzero(is_open)
        if len(pick):
            yield _rows(kind=["open"] * len(pick), block=[block] * len(pick), key=[names[g] for g in pick], parent=[parents[g] for g in pick],
                        depth=np.full(len(pick), d), words=own_words[pick], first=low[pick] == 0, last=high[pick] == len(conv) - 1,
                        **{x: pa.array(held[x][pick], mask=held[x][pick] == _NONE) for x in held})
            pieces = [(names[g], k, _joined(ends[g][k:k + chunk])) for g in pick.tolist() if g in ends for k in range(0, len(ends[g]), chunk)]
            if pieces:
                yield _rows(kind=["ends"] * len(pieces), block=[block] * len(pieces), key=[p[0] for p in pieces], part=[p[1] for p in pieces], ids=[p[2] for p in pieces])


def _peel_sorted(block: int, block_turns: int, chunk: int):
    def run(batches):
        rows, turns_held, k = ([], [], []), 0, 0
        for batch in batches:
            for c, path, words in zip(*(x.to_pylist() for x in batch.columns)):
                for column, value in zip(rows, (c, path, words)):
                    column.append(value)
                turns_held += len(path) // _KEY
                if len(rows[0]) >= block or turns_held >= block_turns:
                    yield from _peel(block_number(k), chunk, *rows)
                    rows, turns_held, k = ([], [], []), 0, k + 1
        if rows[0]:
            yield from _peel(block_number(k), chunk, *rows)
    return run


def _merge(final: bool):
    """Peels the open nodes of neighbouring blocks: equal ones become one, and those that no other block can have close."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        low, high = min(r["block"] for r in rows), max(r["block"] for r in rows)
        nodes = {}
        for r in rows:
            edge = {"first": r["first"] and r["block"] == low, "last": r["last"] and r["block"] == high}
            node = nodes.setdefault(r["key"], r | {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "conv_id": None, "first": False, "last": False})
            for x in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[x] += r[x]
            node["conv_id"] = min((x for x in (node["conv_id"], r["conv_id"]) if x is not None), default=None)
            for x, is_edge in edge.items():
                node[x] = node[x] or is_edge
        for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
            node["kind"] = "open" if not final and (node["first"] or node["last"]) else "node"
            if node["kind"] == "node":
                node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
                node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
                up = nodes.get(node["parent"])
                if up is not None:
                    up["n_children"] += 1
                    for x in ("n_convs", "n_leaves", "saved_tokens"):
                        up[x] += node[x]
                    up["conv_id"] = node["conv_id"] if up["conv_id"] is None else min(up["conv_id"], node["conv_id"])
        for node in nodes.values():
            up = nodes.get(node["parent"])
            node["parent_conv_id"] = up["conv_id"] if node["kind"] == "node" and up is not None and up["kind"] == "node" else None
            # an open node still lies at its side of the group, whichever block it was first seen in
            node["block"] = low if node["first"] and not node["last"] else high
        both = [n | {"block": low, "last": False, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "conv_id": None}
                for n in nodes.values() if n["kind"] == "open" and n["first"] and n["last"] and low != high]
        for n in nodes.values():
            if n["kind"] == "open" and n["first"] and n["last"] and low != high:
                n["first"] = False
        return pa.Table.from_pylist([*nodes.values(), *both], schema=_ARROW)
    return run


def _digests(batches):
    """(key, ends_sha256) of pieces sorted by key and place; a digest takes one piece at a time."""
    key, digest, out = None, None, []
    for batch in batches:
        for name, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if name != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = name, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out])], ["key", "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame, family: int = 20, block: int = BLOCK, block_turns: int = BLOCK_TURNS, chunk: int = CHUNK, round_bits: int = ROUND_BITS) -> DataFrame:
    """Rows (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node.

    `conversations` has conv_id, turn, role and text; other columns are not read. Conversations
    are rebuilt as `paths` says. A node is a distinct sequence of first turns, the root has none;
    key is its chained digest. Repeated turns are turns; an empty table has no nodes. Intermediate
    tables are written to the shared folder, so calling this runs Spark jobs: one round for every
    16-fold of the tasks. A task holds one block of paths, or the open nodes of 16 tasks."""
    spark = conversations.sparkSession
    small_batches(spark)
    order = stored(paths(conversations, family), "paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = stored(order.mapInArrow(_peel_sorted(block, block_turns, chunk), _SCHEMA), "peeled")
    top = found.agg(F.max("block")).first()[0] or 0
    bits, open_nodes, upper = 16 + round_bits, found.filter("kind = 'open'"), None
    while True:
        final = top >> bits == 0
        merged = stored(open_nodes.groupBy(F.shiftright("block", bits).alias("_group")).applyInArrow(_merge(final), _SCHEMA), "merged")
        closed = merged.filter("kind = 'node'")
        upper = closed if upper is None else upper.unionByName(closed)
        if final:
            break
        open_nodes, bits = merged.filter("kind = 'open'"), bits + round_bits
    pieces = found.filter("kind = 'ends'").select("key", "block", "part", "ids").repartition("key").sortWithinPartitions("key", "block", "part")
    digests = pieces.select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")
    upper = upper.drop("ends_sha256").join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    nodes = found.filter("kind = 'node'").unionByName(upper)
    # very many nodes may hang on one open parent: they are dealt over copies of it
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    known = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("_parent"), salts.alias("_salt"))
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = nodes.filter("parent_conv_id is not null or depth = 0").select(*columns)
    lacking = nodes.filter("parent_conv_id is null and depth > 0").withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(known, ["parent", "_salt"]).withColumn("parent_conv_id", F.col("_parent"))
    return whole.unionByName(lacking.select(*columns))
