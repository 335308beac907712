"""Similarity join of word shingle sets by token-combination prefixes.

Sets are sorted in one global order: tokens of the rare class first, then those of the frequent
class, each by hash. Two sets whose Jaccard similarity reaches the threshold share at least K
tokens in their prefixes of length size - ceil(threshold * size) + K. Either one of these is
rare, so single rare tokens of the prefix are indexed; or all are frequent, and as frequent
tokens fall into K - 1 groups by hash, two of them share a group: pairs of frequent prefix tokens
of one group are indexed. K grows with the set size, so that pairs stay about as many as the
tokens. Candidates are verified on whole texts.

Signatures that stand in the same sets, as those of a common passage do, make one bucket with
their number as its weight. A bucket of near copies must not emit all its pairs: first a few rounds link every member to some
leaders, then only pairs across components are left. Of these a bucket gives out only those whose
sketches allow the similarity; what is given out and shares enough tokens is verified."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.graph import components
from gridlake.llm.shared import given_back, joined_words, lower_ascii, mixed, small_batches, stored

WORDS, PERCENT = 5, 80
#: Tokens in more prefixes than this are of the frequent class.
FREQUENT = 64
#: Bits of the filters that tell the classes; their size is fixed, more tokens only make them less selective.
FREQUENT_BITS, SHARED_BITS = 1 << 23, 1 << 26
LEADER_ROUNDS, LEADERS = 3, 4
#: 64-bit words of a set's sketch.
SKETCH_WORDS = 8
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; fewer words than a shingle has make one of all."""
    hashes, bounds = joined_words([lower_ascii((t or "").encode("utf-8", "surrogatepass")) for t in texts])
    m = np.uint64(0x9FB21C651E98DF25)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * m + hashes[k:k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mixed(np.array([short * m + h]))[0]
            out.append(np.array([short]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def size_class(size: int) -> int:
    return size.bit_length() - 1


def groups_of(cls: int) -> int:
    """Hash groups of frequent tokens for sets of that size class; K is one more."""
    return max(1, (1 << cls) // 16)


def classes_of(size: int, percent: int = PERCENT) -> list[int]:
    """Size classes of the set itself and of smaller partners."""
    return sorted({size_class(size), size_class(-(-percent * size // 100))})


def prefix_length(size: int, k: int, percent: int = PERCENT) -> int:
    return min(size, size + (-percent * size) // 100 + k)


def _has_partners(size: int, percent: int) -> bool:
    """Whether a set of another size or content can be similar at all."""
    return 100 * size >= percent * (size + 1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of a set's tokens in 64 * SKETCH_WORDS places: sketches of two sets differ in no more bits than the sets in tokens."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount((tokens >> np.uint64(24)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class Filter:
    """A fixed-size Bloom filter over 64-bit tokens, two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def __contains__(self, tokens):
        raise TypeError("use has()")

    def has(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), bool)
        for t in (tokens, tokens >> np.uint64(32)):
            at = t & self.mask
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _filter(tokens: DataFrame, bits: int) -> np.ndarray:
    """The filter's words. At most bits / 64 rows reach the driver, whatever the number of tokens."""
    words = (tokens.select(F.explode(F.array(F.col("token").bitwiseAND(bits - 1), F.shiftrightunsigned("token", 32).bitwiseAND(bits - 1))).alias("at"))
             .groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def ordered(tokens: np.ndarray, frequent: Filter | None) -> tuple[np.ndarray, int]:
    """The set in the global order and the number of rare tokens."""
    if frequent is None:
        return tokens, len(tokens)
    hot = frequent.has(tokens)
    return np.concatenate([tokens[~hot], tokens[hot]]), int((~hot).sum())


def signatures(tokens: np.ndarray, frequent: Filter, shared: Filter | None, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """Single rare tokens and combinations of frequent ones that index a set; how many single ones; the frequent tokens in its prefix."""
    size = len(tokens)
    if not _has_partners(size, percent):
        return np.empty(0, np.uint64), 0, 0
    sequence, rare = ordered(tokens, frequent)
    classes = classes_of(size, percent)
    longest = prefix_length(size, max(groups_of(c) for c in classes) + 1, percent)
    single = sequence[:min(rare, longest)]
    out = [single if shared is None else single[shared.has(single)]]
    for c in classes:
        g = groups_of(c)
        hot = sequence[rare:prefix_length(size, g + 1, percent)]
        if len(hot) < 2:
            continue
        group = mixed(hot) % np.uint64(g)
        order = np.lexsort((hot, group))
        hot, group = hot[order], group[order]
        for step in range(1, len(hot)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            a, b = hot[:-step][same], hot[step:][same]
            out.append(mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b + np.uint64(c))))
    return np.concatenate(out), len(out[0]), max(0, longest - rare)


def _slices(batch: pa.RecordBatch, column: int, rows: int = 256):
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        yield part, part.column(column).to_pylist()


def _prefix_tokens(docs: DataFrame, words: int, percent: int, hot=None) -> DataFrame:
    """Prefix tokens of every document, one a row."""
    @given_back
    def run(batches):
        frequent = Filter(hot.value) if hot is not None else None
        for batch in batches:
            found = []
            for _, texts in _slices(batch, 0):
                for tokens in shingle_sets(texts, words):
                    size = len(tokens)
                    if _has_partners(size, percent):
                        sequence, rare = ordered(tokens, frequent)
                        k = max(groups_of(c) for c in classes_of(size, percent)) + 1
                        found.append(sequence[:prefix_length(size, k, percent) if hot is None else min(rare, prefix_length(size, k, percent))])
            found = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["token"])

    return docs.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def indexed(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, digest, signatures, single, hot, s0.., text): the text only where there are signatures.

    Three passes over the texts: token counts in hash order find the frequent class, counts in
    the final order find the rare tokens that two documents share, the last makes signatures."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    hot = context.broadcast(_filter(_prefix_tokens(docs, words, percent).filter(F.col("n") > frequent), FREQUENT_BITS))
    known = context.broadcast(_filter(_prefix_tokens(docs, words, percent, hot).filter(F.col("n") > 1), SHARED_BITS))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @given_back
    def run(batches):
        common, shared = Filter(hot.value), Filter(known.value)
        for batch in batches:
            for part, texts in _slices(batch, 1):
                sets = shingle_sets(texts, words)
                marks = [signatures(s, common, shared, percent) for s in sets]
                sketches = np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH_WORDS)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([m.view(np.int64) for m, _, _ in marks], pa.list_(pa.int64())),
                    pa.array([x for _, x, _ in marks], pa.int32()), pa.array([x for _, _, x in marks], pa.int32()),
                    *[pa.array(np.ascontiguousarray(x)) for x in sketches.T],
                    pa.array([t if len(m) else None for t, (m, _, _) in zip(texts, marks)], pa.string())],
                    ["doc_id", "n_shingles", "digest", "signatures", "single", "hot", *SKETCH, "text"])

    return stored(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_shingles long, digest binary, signatures array<long>, single int, hot int, {', '.join(f'{c} long' for c in SKETCH)}, text string"), "index")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    @given_back
    def run(batches):
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            at, kept_sets = 0, {}
            for part, left in _slices(batch, 2, 64):
                right = part.column(3).to_pylist()
                new = list({t for t in (*left, *right) if t not in kept_sets})
                kept_sets = {t: s for t, s in kept_sets.items() if t in {*left, *right}} | dict(zip(new, shingle_sets(new, words)))
                for x, y in zip(left, right):
                    kept[at] = similar(kept_sets[x], kept_sets[y], percent)
                    at += 1
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    # the texts of the pairs only, so that not all texts are shuffled
    texts = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
    rows = (pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b")
            .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right"))
    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def similarity_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT,
                          leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents.

    ASCII letters are lower-cased; words are runs of other characters than space, tab and line
    breaks. A text without words (or null) has an empty set and is linked with nothing. Equal
    sets form a class with one representative, the least doc_id; classes are linked through
    their representatives. Rows that repeat a doc_id are kept and count as one node. Other
    columns are ignored. Shingles are compared by 64-bit hashes."""
    index = indexed(docs.select("doc_id", "text"), words, percent, frequent)
    classes = index.filter("n_shingles > 0").groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep"))
    members = stored(index.select("doc_id", "n_shingles", "digest").join(classes, ["n_shingles", "digest"], "left")
                     .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    # one row of each class; repeated rows fall together in the exchange of the join
    key = ["doc_id", "n_shingles", "digest"]
    own = (index.filter(F.size("signatures") > 0).select(*key, "signatures", "single", "hot")
           .join(classes.withColumnRenamed("rep", "doc_id"), key).dropDuplicates(key))
    texts = index.filter(F.size("signatures") > 0).select(F.col("doc_id").alias("rep"), "text")
    buckets = own.select(F.explode(F.array_distinct("signatures")).alias("signature"), F.col("doc_id").alias("rep"),
                         F.col("n_shingles").alias("n"), "single", "hot", F.col("doc_id").alias("comp"))
    # tokens that the prefixes must share, less the frequent ones: see the module
    k = "greatest(1, shiftright(shiftleft(1, length(bin(least(n, m))) - 1), 4)) + 1"
    overlap = f"(({percent} * (n + m) + {99 + percent}) div {100 + percent})"
    both = ", ".join(f"least({x}, {x} - ({percent} * {x} + 99) div 100 + {k}) - ({x} - {overlap})" for x in ("n", "m"))
    need = f"(least({both}) - least(hot, other_hot))"
    enough = F.expr(f"n_shared >= {need}")
    apart = " + ".join(f"bit_count({c} ^ other_{c})" for c in SKETCH)
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and {need} <= least(single, other_single)")
    alike = F.expr(f"{apart} <= n + m - 2 * {overlap}")
    links = tested = None

    def open_buckets(rows):
        """Rows of the buckets that several components share."""
        several = rows.groupBy("signature").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("signature")
        return stored(rows.join(several, "signature"), "buckets")

    def merged(rows):
        """The same with one bucket for all that hold the same rows, which are told apart by their first, last, number and sums of
        hashes; `weight` is how many it stands for."""
        row = F.xxhash64("rep", "n", "single", "hot")
        held = rows.groupBy("signature").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"),
                                             F.sum(F.shiftright(row, 32)).alias("high"), F.sum(row.bitwiseAND(0xFFFFFFFF)).alias("low"))
        alike = held.filter("x <> y").groupBy("x", "y", "size", "high", "low").agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("weight"))
        return stored(rows.join(alike.select("signature", "weight"), "signature"), "buckets")

    def named(rows):
        """The rows of a bucket as the first of a pair."""
        return rows.select(*[F.col(c).alias({"rep": "a", "n": "m", "comp": "other"}.get(c, c if c == "signature" else f"other_{c}")) for c in rows.columns if c != "weight"])

    def check(pairs):
        """Verifies the pairs of a row per shared bucket (a, b with sizes m, n, frequent tokens other_hot, hot, the bucket's weight)."""
        nonlocal links, tested
        pairs = pairs.groupBy("a", "b", "n", "m", "hot", "other_hot").agg(F.sum("weight").alias("n_shared")).filter(enough)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = stored(_verified(pairs, texts, words, percent), "similar")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)

    buckets = merged(buckets)
    for turn in range(leader_rounds):
        if buckets.isEmpty():
            break
        order = Window.partitionBy("signature").orderBy(F.xxhash64("rep", F.lit(turn)), "rep")
        leaders = named(buckets.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= LEADERS).drop("_place"))
        check(buckets.join(leaders, "signature").filter((F.col("comp") != F.col("other")) & fits).select("a", F.col("rep").alias("b"), "n", "m", "hot", "other_hot", "weight"))
        label = stored(components(links), "components")
        buckets = open_buckets(buckets.drop("comp").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
            "signature", "weight", "rep", "n", "single", "hot", F.coalesce("component", "rep").alias("comp")))
    if not buckets.isEmpty():
        # of rows that repeat an id each sketch meets the buckets; wrong pairs fail the verification
        sketches = index.filter(F.size("signatures") > 0).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *SKETCH).distinct()
        buckets = buckets.join(sketches, ["rep", "n"])
        check(buckets.join(named(buckets), "signature").filter((F.col("comp") < F.col("other")) & fits & alike).select("a", F.col("rep").alias("b"), "n", "m", "hot", "other_hot", "weight"))
    if links is None:
        return members.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    label = components(links).withColumnRenamed("node", "rep")
    # rows that repeat an id may belong to different classes: they still are one node
    return members.join(label, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
