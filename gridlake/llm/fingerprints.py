"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph (a non-blank line) hashes to a wide vector; a text's fingerprint is the sum of its
paragraphs' vectors modulo powers of two. Sums do not depend on order, and a paragraph is
inserted or deleted by adding or subtracting its vector. The vector has two parts:

* LANES numbers modulo 2**32, each a hash of the paragraph's SHA-256 and the lane: equality;
* SKETCH numbers modulo 2**16, the signed count sketch of the paragraph's sentences: their dot
  products estimate shared sentences, hence likeness, with an error near 1/sqrt(SKETCH)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.shared import text_or_empty

LANES, SKETCH = 32, 64
_BLANK = r"^[\x20\x09-\x0D]*$"


def _sum_lanes(digests: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda lane: F.aggregate(
        digests, F.lit(0).cast("long"), lambda a, d: (a + F.xxhash64(d, lane)).bitwiseAND(0xFFFFFFFF)))


def _centred(x: Column) -> Column:
    """The representative of x modulo 2**16 between -2**15 and 2**15 - 1."""
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def _sum_sketch(cells: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda lane: _centred(
        F.size(F.filter(cells, lambda c: c == 2 * lane)) - F.size(F.filter(cells, lambda c: c == 2 * lane + 1))))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds `name`: struct(lanes array<bigint>, sketch array<int>) of the text; null text counts as empty, whose vector is 0."""
    t, d, c = f"{name}_t", f"{name}_d", f"{name}_c"
    return (df.withColumn(t, F.coalesce(text, F.lit("")))
            .withColumn(d, F.transform(F.filter(F.split(t, "\n"), lambda p: ~p.rlike(_BLANK)), lambda p: F.sha2(p, 256)))
            .withColumn(c, F.transform(F.filter(F.split(t, r"[.!?\n]+"), lambda p: ~p.rlike(_BLANK)),
                                       lambda p: F.pmod(F.xxhash64(F.trim(p)), F.lit(2 * SKETCH))))
            .drop(t)
            .withColumn(name, F.struct(_sum_lanes(F.col(d)).alias("lanes"), _sum_sketch(F.col(c)).alias("sketch")))
            .drop(d, c))


def added(a: str, b: str) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.struct(F.zip_with(f"{a}.lanes", f"{b}.lanes", lambda x, y: (x + y).bitwiseAND(0xFFFFFFFF)).alias("lanes"),
                    F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: _centred(x + y)).alias("sketch"))


def removed(a: str, b: str) -> Column:
    """Fingerprint of `a` without the paragraphs of `b`."""
    return F.struct(F.zip_with(f"{a}.lanes", f"{b}.lanes", lambda x, y: (x - y).bitwiseAND(0xFFFFFFFF)).alias("lanes"),
                    F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: _centred(x - y)).alias("sketch"))


def as_text(name: str) -> Column:
    """The fingerprint in lowercase hexadecimal digits: 8 a lane, 4 a sketch number."""
    return F.concat(F.array_join(F.transform(f"{name}.lanes", lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
                    F.array_join(F.transform(f"{name}.sketch", lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(65535))), 4, "0")), ""))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: str, b: str) -> Column:
    """1 for equal fingerprints, else the cosine of the sketches, at least 0; 0 if one has no sentence."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return (F.when(F.col(a) == F.col(b), 1.0).when(norm == 0, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / norm))))


def with_next(df: DataFrame, columns: dict[str, str], id_column: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Adds for every row the given columns of the next row by ascending id (after the last: the first), under new names.

    One shuffle of the rows: quantiles of the ids cut them into buckets, and each bucket's
    first rows are also sent to the bucket before, where they stand last. What reaches the
    driver is one id per bucket. Equal ids are ordered by all the columns asked for; a null
    id counts as the least."""
    spark = df.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    ids = df.select(key.alias("key"))
    found = ids.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else None
    edges = sorted(set(found or []))
    depth = len(edges).bit_length()
    padded = F.array([F.lit(e).cast("long") for e in edges + [None] * ((1 << depth) - 1 - len(edges))]) if edges else None

    def bucket(k: Column) -> Column:
        """How many edges are at most k, by binary search."""
        if not edges:
            return F.lit(0)
        steps = F.array([F.lit(1 << s) for s in reversed(range(depth))])
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(padded, low + step - 1) <= k, low + step).otherwise(low))

    firsts = {r["bucket"]: r["first"] for r in ids.groupBy(bucket(F.col("key")).alias("bucket")).agg(F.min("key").alias("first")).collect()}
    full = sorted(firsts)
    before = {b: full[k - 1] for k, b in enumerate(full)}       # the first bucket follows the last
    n = len(edges) + 1
    first_of = F.array([F.lit(firsts.get(b)).cast("long") for b in range(n)])
    before_of = F.array([F.lit(before.get(b)).cast("int") for b in range(n)])
    rows = df.withColumn("_key", key).withColumn("_own", bucket(F.col("_key")))
    here = F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("ghost"))
    there = F.struct(F.get(before_of, F.col("_own")).alias("bucket"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("_at", F.explode(F.when(F.get(first_of, F.col("_own")) == F.col("_key"), F.array(here, there)).otherwise(F.array(here))))
    # columns of their own, so that all leads share one window and one exchange
    rows = rows.withColumn("_bucket", F.col("_at.bucket")).withColumn("_ghost", F.col("_at.ghost")).drop("_at", "_own")
    window = Window.partitionBy("_bucket").orderBy("_ghost", "_key", *columns)
    rows = rows.select("*", *(F.lead(old).over(window).alias(new) for old, new in columns.items()))
    return rows.filter("_ghost = 0").drop("_key", "_bucket", "_ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    of the next document. Null text is empty; other columns of `docs` are ignored; repeated
    rows are kept, and of equal ids each follows the other."""
    rows = with_fingerprint(docs.select("doc_id", text_or_empty().alias("text")), F.col("text"), "print")
    rows = with_next(rows, {"text": "next_text", "print": "next_print"})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.expr(
        "concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, n_chars div 2))"))
    rows = with_fingerprint(rows.select("doc_id", "n_chars", "edited", "print", "next_print"), F.col("edited"), "edited_print")
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"),
                       likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"))
