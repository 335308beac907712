"""The corpus queries and the SQL that some of them must agree with."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.packing import packed
    return packed(_read(spark, sf_dir, "documents")).drop("ids")


def op2_suffix_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from gridlake.llm.suffix_dedup import deduplicated
    rows = deduplicated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.langid import held_out, identified, train
    docs = _read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.fingerprints import fingerprints
    return fingerprints(_read(spark, sf_dir, "documents"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.quality import quality_cascade
    return quality_cascade(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from gridlake.llm.bpe import decoded, encoded
    rows = decoded(encoded(_read(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlake.llm.jaccard import similarity_components
    return similarity_components(_read(spark, sf_dir, "documents"))


def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from gridlake.llm.sharding import sharded
    return sharded(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from gridlake.llm.pitman_yor import scored
    return scored(_read(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0)


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from gridlake.llm.shared import shared_path
    from gridlake.llm.warc import read_archives, write_archives
    path = shared_path(spark, "archives")
    write_archives(_read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).filter("kind = 'record'").select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's highest-scoring phrases of two to five words over all documents."""
    from gridlake.llm.phrases import collocations
    return collocations(_read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt on the heads of their families of twenty."""
    from gridlake.llm.prefix_trie import prefix_trie
    return prefix_trie(_read(spark, sf_dir, "conversations")).drop("key")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document by the byte-level vocabulary, as digests."""
    from pyspark.sql import functions as F
    from gridlake.llm.byte_bpe import decoded, encoded
    rows = decoded(encoded(_read(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_lexical_packing, op2_suffix_deduplication, op3_language_spans, op4_multiset_fingerprints, op5_quality_cascade, op6_bpe_round_trip, op7_jaccard_components, op8_vector_sharding, op9_pitman_yor_scores, op10_warc_salvage, op11_phrase_collocations, op12_conversation_trie, op13_byte_bpe, pipeline)}

_WORDS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)"""

SQL = {
    "op5_quality_cascade": _WORDS + r""",
m AS (SELECT doc_id, t, ws, len(ws) AS n_words, len(ls) AS n_lines, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
             unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT m.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * len(regexp_extract_all(t, '\p{Lu}')) > len(regexp_extract_all(t, '\p{L}'))
            OR 4 * len(regexp_extract_all(t, '!')) > n_words
            OR 10 * len(list_filter(ws, lambda v: regexp_matches(v, '\p{L}'))) < 7 * n_words
            OR (n_words >= 200 AND 20 * len(list_distinct(ws)) < n_words)) AS kept
FROM f""",
    "op10_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, h) AS first FROM p),
b AS (SELECT page_id, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
        (CAST('0x' || substr(x, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS d FROM p)
SELECT f.page_id, strlen(h) AS payload_bytes, d AS payload_digest,
       CASE WHEN f.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.page_id <> first THEN first END AS refers_to
FROM f JOIN b USING (page_id)""",
    "op11_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) AS s(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING m = 1 OR count(*) >= 100),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM (
    SELECT lang, a, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, m, a, ws, k, unnest(range(1, m - k + 2)) AS i FROM c, range(2, 5) AS s(k) WHERE k < m)) AS b
  JOIN c AS s USING (lang, phrase) WHERE 100 * b.a >= 100 * s.a),
x AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, ws, m FROM c),
y AS (SELECT x.lang, x.phrase, x.a, k, l.a AS l, r.a AS r, n, (CAST(1000 AS HUGEINT) * x.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:k], ' ')
      JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000""",
    "op12_conversation_trie": r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, turn, text, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS x FROM t),
o AS (SELECT c, x, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) - 1 AS i FROM s),
crc AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
              lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT crc.c, 0 AS part, i, x, text FROM crc JOIN o ON o.c = crc.c - crc.c % 20 WHERE i < h
      UNION ALL SELECT o.c, 1, i, x, text FROM o JOIN crc USING (c) WHERE i >= h),
l AS (SELECT crc.c, coalesce(list(x ORDER BY part, i) FILTER (WHERE x IS NOT NULL), []) AS xs, list(text ORDER BY part, i) AS ts FROM crc LEFT JOIN r USING (c) GROUP BY crc.c),
p AS (SELECT c, len(xs) AS len, unnest(range(0, len(xs) + 1)) AS d, xs, ts FROM l),
m AS (SELECT c, d, len = d AS ends, array_to_string(xs[1:d], '') AS key,
             CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d], '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
k AS (SELECT substr(key, 1, 64 * (d - 1)) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
u AS (SELECT substr(key, 1, 64 * a) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM b) GROUP BY ALL)
SELECT b.conv_id, b.d AS depth, f.conv_id AS parent_conv_id, b.n_convs, b.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, b.ends_sha256
FROM b JOIN u USING (key) LEFT JOIN n AS f ON b.d > 0 AND f.key = substr(b.key, 1, 64 * (b.d - 1))""",
}
