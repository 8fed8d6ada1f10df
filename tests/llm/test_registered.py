"""The registered queries on the smallest tables: columns, one row per input row, and SQL where there is some."""

import glob
import os

import pytest

from barlake.llm.oracle import ORACLE
from barlake.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

TABLES = {"op4_site_style_tree": "pages", "op8_multi_index": None, "op11_conversation_repair": None, "op13_bond_negatives": None}
COLUMNS = {
    "op1_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint",
                         "kept_sha256": "string"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_site_style_tree": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_order_minhash": {"doc_id": "bigint", "group_id": "bigint"},
    "op6_neighbour_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                          "items_sha256": "string", "contaminated": "boolean"},
    "op10_chunk_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint",
                         "kept_sha256": "string"},
    "op11_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint",
                                 "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string",
                                 "repaired_sha256": "string"},
    "op12_divide_skip": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op13_bond_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                            "positive_score": "bigint", "negative_score": "bigint"}}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    assert COLUMNS[name].items() <= dict(found.dtypes).items()
    rows = found.collect()
    table = TABLES.get(name, "documents")
    if table:
        key = found.columns[0]
        ids = duck.execute(f"SELECT {key} FROM {table}").fetchall()
        assert sorted(r[key] for r in rows) == sorted(i for i, in ids)
    if name in ORACLE:
        answer = duck.execute(ORACLE[name])
        columns = [c[0] for c in answer.description]
        assert sorted(columns) == sorted(found.columns)
        assert sorted(map(repr, ([r[c] for c in columns] for r in rows))) == sorted(
            repr(list(r)) for r in answer.fetchall())


def test_entry_registers_all():
    import __spark_entry__ as driver

    assert set(QUERIES) <= set(driver.queries()) and "pipeline" in driver.queries()
    assert set(ORACLE) <= set(driver.oracle_sql())
