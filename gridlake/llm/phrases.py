"""Phrase collocations by set-oriented mining of occurrence relations (SETM).

The occurrences of the groups of m words form a relation, sorted by piece and position and
stored, one row per block of texts. Merge-joining it with itself on the same piece and the
adjacent position gives the occurrences of the groups of m + 1 words, whose counts are summed
over all blocks; a semi-join with the frequent groups gives the next relation. Counts are
summed in each block first and travel in parts by a hash of the group, packed together, so a
group has at most one entry per block, however frequent."""
from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.blocks import Codes, block_number, bucketed, by_part, compressed, from_planes, joined, part_of_word, planes, sections, split
from gridlake.llm.shared import mixed, small_batches, stored, text_or_empty

#: Words per block; a longer document is a block of its own.
BLOCK = 1 << 22
#: Bytes of text per part; a part holds at most the groups that about so much text has.
PART_BYTES = 1 << 24
_BREAK = b"\n"
_TO_TOKENS = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\n\x0b\x0c\r\t", string.ascii_lowercase.encode() + _BREAK * 10 + b" ")


class _Words(dict):
    """Numbers the words of one language in a list shared by all languages of the block; 0 is a break, -1 nothing."""

    def __init__(self, lang, names):
        super().__init__({_BREAK: 0, b"": -1})
        self.lang, self.names = lang, names

    def __missing__(self, word):
        self[word] = code = len(self.names)
        self.names.append((self.lang, word))
        return code


def _explode(block: int, n_parts: int):
    """A row of codes in text order per block, where a zero ends a piece, and its words with their counts in parts."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])

    def run(batches):
        names, langs, codes, n, k = [(None, b"")], {}, [], 0, 0

        def flush():
            every, number = np.concatenate(codes), block_number(k)
            counts = np.bincount(every, minlength=len(names))
            known = list(langs)
            spelt = joined([x.encode() for x in known])
            code_of = {x: i for i, x in enumerate(known)}
            lang = np.array([code_of.get(x, 0) for x, _ in names])
            part = np.array([part_of_word(w, n_parts) for _, w in names[1:]], np.int64)
            rows = [{"block": number, "part": -1, "data": compressed(planes(every), planes(part))}]
            for own in by_part(part):
                ks = own + 1
                rows.append({"block": number, "part": int(part[own[0]]), "data": compressed(
                    planes(counts[ks]), planes(lang[ks]), spelt, joined([names[i][1] for i in ks.tolist()]))})
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[a:a + 1000], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = langs.get(lang)
                if words is None:
                    words = langs[lang] = _Words(lang, names)
                tokens = text.encode().translate(_TO_TOKENS).replace(_BREAK, b" \n ").split(b" ")
                own = np.array(list(map(words.__getitem__, tokens)), np.int32)
                own = own[own >= 0]
                codes.append(np.append(own, 0).astype(np.int32))
                n += len(own) + 1
                if n > block:
                    yield from flush()
                    names, langs, codes, n, k = [(None, b"")], {}, [], 0, k + 1
        if codes:
            yield from flush()
    return run


#: What counting a part gives: `group` rows of frequent groups, `total` rows of words per language, and a `back` row per
#: block that tells which of its groups are frequent, in the order in which it sent them, and their numbers.
_COUNTED = "kind string, block long, part long, data binary, gid long, first long, last long, a long, lang string, word binary"
_COUNTED_ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _COUNTED.split(", ")])


def _counted(**columns) -> pa.Table:
    size = len(columns["kind"])
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _COUNTED_ARROW], schema=_COUNTED_ARROW)


def _numbered(part: int, n_parts: int, totals: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent groups of a part, the most frequent first, and a number for every group (-1: not frequent)."""
    often = np.flatnonzero(totals >= least)
    often = often[np.argsort(-totals[often], kind="stable")]
    gid = np.full(len(totals), -1)
    gid[often] = part + n_parts * np.arange(len(often))
    return often, gid


def _back(part: int, blocks: list[int], gids: list[np.ndarray]) -> pa.Table:
    rows = [(b, compressed(np.packbits(g >= 0).tobytes(), planes(g[g >= 0]))) for b, g in zip(blocks, gids) if (g >= 0).any()]
    return _counted(kind=["back"] * len(rows), block=[b for b, _ in rows], part=[part] * len(rows), data=[d for _, d in rows])


def _count_words(n_parts: int, least: int):
    def run(rows: pa.Table) -> pa.Table:
        number, own, counts = Codes(), [], []
        for data in rows["data"].to_pylist():
            n, lang, spelt, words = sections(data)
            langs = split(spelt)
            counts.append(from_planes(n))
            own.append(np.fromiter((number[langs[x], w] for x, w in zip(from_planes(lang).tolist(), split(words))), np.int64, len(counts[-1])))
        totals = np.zeros(len(number), np.int64)
        np.add.at(totals, np.concatenate(own), np.concatenate(counts))
        part = rows["part"][0].as_py()
        often, gid = _numbered(part, n_parts, totals, least)
        names, per_lang = list(number), {}
        for (lang, _), n in zip(names, totals.tolist()):
            per_lang[lang] = per_lang.get(lang, 0) + n
        return pa.concat_tables([
            _counted(kind=["group"] * len(often), gid=gid[often], a=totals[often], lang=[names[i][0].decode() for i in often], word=[names[i][1] for i in often]),
            _counted(kind=["total"] * len(per_lang), lang=[x.decode() for x in per_lang], a=list(per_lang.values())),
            _back(part, rows["block"].to_pylist(), [gid[x] for x in own])])
    return run


def _sent_pairs(first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs in ascending order: steps of the first group, and of the last one within pairs of the same first."""
    step = np.diff(last, prepend=0)
    begins = np.diff(first, prepend=-1) != 0
    step[begins] = last[begins]
    return compressed(planes(np.diff(first, prepend=0)), planes(step), planes(counts))


def _received_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, step, counts = map(from_planes, sections(data))
    first = np.cumsum(first)
    begins = np.flatnonzero(np.diff(first, prepend=-1) != 0)
    total = np.cumsum(step)
    last = total - np.repeat(total[begins] - step[begins], np.diff(np.append(begins, len(first))))
    return first, last, counts


def _count_pairs(n_parts: int, least: int):
    def run(rows: pa.Table) -> pa.Table:
        part, sent = rows["part"][0].as_py(), [_received_pairs(data) for data in rows["data"].to_pylist()]
        bounds = np.cumsum([len(x[0]) for x in sent])[:-1]
        first, last, counts = (np.concatenate(x) for x in zip(*sent))
        del sent
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(counts[order], starts)
        often, gid = _numbered(part, n_parts, totals, least)
        own = np.empty(len(order), np.int64)
        own[order] = gid[np.cumsum(new) - 1]
        return pa.concat_tables([
            _counted(kind=["group"] * len(often), gid=gid[often], a=totals[often], first=first[starts[often]], last=last[starts[often]]),
            _back(part, rows["block"].to_pylist(), np.split(own, bounds))])
    return run


def _kept(block: int, places: np.ndarray, local: np.ndarray, size: int, parts: dict[int, np.ndarray], frequent: pa.Table) -> pa.Table:
    """The semi-join within a block: occurrences of frequent groups, renumbered in the order of the groups' numbers.

    ``parts`` holds a block's groups in the order in which it sent them to each part."""
    ks, gids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part, data in zip(frequent["part"].to_pylist(), frequent["data"].to_pylist()):
        mask, numbers = sections(data)
        sent = parts[part]
        ks.append(sent[np.unpackbits(np.frombuffer(mask, np.uint8), count=len(sent)).astype(bool)])
        gids.append(from_planes(numbers))
    ks, gids = np.concatenate(ks), np.concatenate(gids)
    order = np.argsort(gids)
    number = np.full(size, -1, np.int64)
    number[ks[order]] = np.arange(len(order))
    groups = number[local]
    inside = groups >= 0
    data = compressed(planes(np.diff(places[inside], prepend=0)), planes(groups[inside]), planes(gids[order]))
    return pa.table({"block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})


def _singles(codes: pa.Table, frequent: pa.Table) -> pa.Table:
    every, part = map(from_planes, sections(codes["data"][0].as_py()))
    parts = {int(part[own[0]]): own + 1 for own in by_part(part)}
    return _kept(codes["block"][0].as_py(), np.arange(len(every)), every, len(part) + 1, parts, frequent)


def _merged(data: bytes):
    """Merge-join of a block's relation with itself at adjacent positions of a piece: where, the pairs, and all groups' numbers.

    A pair stands for two groups that overlap in all but one word each, as first * (number of groups) + second."""
    steps, groups, gids = map(from_planes, sections(data))
    places = np.cumsum(steps)
    at = np.flatnonzero(steps[1:] == 1)      # a break between pieces takes a position of its own
    return places[at], groups[at] * max(len(gids), 1) + groups[at + 1], gids


def _parts_of(pairs: np.ndarray, gids: np.ndarray, n_parts: int):
    """First and last groups of distinct pairs in ascending order, and where each part's pairs stand."""
    first, last = gids[pairs // max(len(gids), 1)], gids[pairs % max(len(gids), 1)]
    part = (mixed(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    return first, last, {int(part[own[0]]): own for own in by_part(part)}


def _extend(n_parts: int):
    """A block's groups of one word more with their counts, as the groups of all but the last and all but the first word, in parts."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, pairs, gids = _merged(batch["data"][row].as_py())
                pairs, counts = np.unique(pairs, return_counts=True)
                first, last, parts = _parts_of(pairs, gids, n_parts)
                block, rows = batch["block"][row].as_py(), [(p, _sent_pairs(first[own], last[own], counts[own])) for p, own in parts.items()]
                for a in range(0, len(rows), 1000):
                    some = rows[a:a + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array([p for p, _ in some], pa.int32()),
                                                      pa.array([d for _, d in some], pa.binary())], ["block", "part", "data"])
    return run


def _longer(n_parts: int):
    def run(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        places, pairs, gids = _merged(relation["data"][0].as_py())
        pairs, local = np.unique(pairs, return_inverse=True)
        return _kept(relation["block"][0].as_py(), places, local, len(pairs), _parts_of(pairs, gids, n_parts)[2], frequent)
    return run


_PACKED = "block long, part int, data binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _first_pairs(n_parts: int):
    """Pairs of adjacent frequent words: the semi-join of the single words is made on the way, not stored."""
    def run(codes: pa.Table, frequent: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_extend(n_parts)(_singles(codes, frequent).to_batches()), schema=_PACKED_ARROW)
    return run


def _second(n_parts: int):
    """The relation of frequent pairs from the codes of a block and what is frequent of its words and pairs."""
    def run(codes: pa.Table, frequent: pa.Table) -> pa.Table:
        words, pairs = (frequent.filter(pc.equal(frequent["level"], level)) for level in (1, 2))
        return _longer(n_parts)(_singles(codes, words), pairs)
    return run


def _exact(column) -> F.Column:
    return F.col(column).cast("decimal(19,0)") if isinstance(column, str) else column.cast("decimal(19,0)")


def _cut(m: int) -> F.Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase of m words; the smallest k of equals."""
    cuts = []
    for k in range(1, m):
        left, right = F.col("heads")[k - 1], F.col("tails")[m - k - 1]
        score = F.call_function("div", _exact(1000 * F.col("a")) * _exact("n"), _exact(left) * _exact(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return cuts[0] if m == 2 else F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `longest` words.

    Words are lower-cased (A-Z) and lie between spaces or tabs of a piece; `.,;:!?` and line
    breaks end a piece. a counts a phrase, n all words of the language, l and r the two parts of
    the cut with the lowest score floor(1000 * a * n / (l * r)). Phrases found less than `least`
    times are none; one that lies in a longer one of the same count is dropped. Order: score and
    a descending, then the phrase in byte order. Null text is empty, null lang is `und`, repeated
    rows count again, other columns are not read; empty tables give no rows. Each relation is
    written once to the shared folder, so calling it runs Spark jobs. A task holds a block, or
    a part: the groups whose hash falls there, of all blocks, packed. The number of parts follows
    the bytes of all texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    parts = bucketed(rows.mapInArrow(_explode(block, n_parts), _PACKED), "occurrences")
    codes = parts.filter("part < 0").select("block", "data")

    def frequent(found, level):
        return found.filter("kind = 'back'").select("block", F.lit(level).alias("level"), "part", "data")

    def together(left, right, function, schema):
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(function, schema)

    def counted(pairs):
        return stored(pairs.groupBy("part").applyInArrow(_count_pairs(n_parts, least), _COUNTED), "groups")

    words = stored(parts.filter("part >= 0").groupBy("part").applyInArrow(_count_words(n_parts, least), _COUNTED), "groups")
    totals = words.filter("kind = 'total'").groupBy("lang").agg(F.sum("a").alias("n"))
    text = F.col("word").cast("string")
    groups = stored(words.filter("kind = 'group'").select(
        "gid", "lang", "a", text.alias("phrase"), text.alias("tail"), F.array("a").alias("heads"), F.array("a").alias("tails")), "phrases")
    results = []
    for m in range(2, longest + 1):
        if m == 2:
            found = counted(together(codes, frequent(words, 1), _first_pairs(n_parts), _PACKED))
            following = together(codes, frequent(words, 1).unionByName(frequent(found, 2)), _second(n_parts), "block long, data binary")
        else:
            found = counted(relation.mapInArrow(_extend(n_parts), _PACKED))
            following = together(relation, frequent(found, m), _longer(n_parts), "block long, data binary")
        if m < longest:
            relation = bucketed(following, "relation")
        head = groups.select(F.col("gid").alias("first"), "lang", F.col("phrase").alias("start"), "heads")
        last = groups.select(F.col("gid").alias("last"), "tail", "tails")
        longer = stored(found.filter("kind = 'group'").select("gid", "first", "last", "a").join(head, "first").join(last, "last").select(
            "gid", "first", "last", "lang", "a", F.concat_ws(" ", "start", "tail").alias("phrase"), "tail",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails")), "phrases")
        if m > 2:       # what is as frequent one word longer adds nothing; any longer cover implies one of a single word more
            covered = longer.filter(F.col("a") >= F.element_at("heads", -2)).select(F.col("first").alias("gid")).unionByName(
                longer.filter(F.col("a") >= F.element_at("tails", -2)).select(F.col("last").alias("gid")))
            results.append((m - 1, groups.join(covered, "gid", "left_anti")))
        groups = longer
    results.append((longest, groups))

    scored = [df.join(totals, "lang").withColumn("cut", _cut(m)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score") for m, df in results]
    every = reduce(DataFrame.unionByName, scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of every part of a language, then the first of what is left
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    some = every.withColumn("rank", part).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
