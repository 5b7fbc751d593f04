"""Registered queries against their SQL on the smallest tables."""

import importlib
import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
ENTRY = importlib.import_module("__spark_entry__")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# one query per family; all of them are compared by the driver
SAMPLE = [
    "read_xml_records", "append_index", "valid_docs", "triples", "set_triples", "token_dim",
    "vec_num_ml", "vec_str_decay", "fingerprint", "fingerprint_v1", "fingerprint_rows",
    "corr_histogram", "pairs_cross", "topk_pairs", "read_json_map", "read_xml_tree", "vec_num_smooth",
    "index_pos", "pair_names", "stream_index", "pca_fp", "valid_docs_lines", "valid_docs_xml",
    "token_dictionary", "read_triples_lossless", "corr_histogram_orders", "multi_length_side_by_side",
    "query_raw", "array_links",
]

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    as_text = lambda x: str(float(x)) if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(as_text(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    """The queries of add-ons have tests of their own."""
    added = {name for module in ENTRY.ADDED for name in module.QUERIES}
    assert set(ENTRY.queries()) - set(ENTRY.oracle_sql()) <= added


@needs_data
def test_entry(spark):
    assert ENTRY.entry(spark).columns == ["doc_id", "i", "v"]


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = ENTRY.queries()[name](spark, FOLDER)
    expected = con.sql(ENTRY.oracle_sql()[name])
    assert plain(found.columns, found.collect()) == plain(expected.columns, expected.fetchall())
