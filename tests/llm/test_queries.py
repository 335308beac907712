"""The registered corpus queries: contract columns, and their SQL where there is any."""
import duckdb
import pytest

import __spark_entry__ as entry
from gridlake.llm.queries import QUERIES, SQL
from verify import TABLES, compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3": "doc_id held_out lang_pred score", "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "doc_id n_shingles component_id", "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score", "op10": "page_id payload_bytes payload_digest record_type refers_to",
    "op11": "lang rank phrase a l r n score", "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(QUERIES[name](spark, SF), con.sql(SQL[name])) is None


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_language_spans", "op8_vector_sharding", "op6_bpe_round_trip", "op13_byte_bpe"])
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name.split("_")[0]].split() and df.count() == 200
