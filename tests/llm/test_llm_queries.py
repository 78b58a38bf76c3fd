"""The queries of the subpackage that have SQL give the same rows, and every found-query runs on the smallest tables."""

import pytest

from codequarry.llm.catalogue import modules
from tests.oracle import compare

QUERIES = {n: f for m in modules() for n, f in m.QUERIES.items()}
SQL = {n: s for m in modules() for n, s in m.SQL.items()}
FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": "tbl string, row_key string, field_name string, pii_type string", "p5_found": "repo_id string, path string", "p6_found": "symbol_id bigint", "p7_found": "call_id bigint, defect string",
    "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint, grade int",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and (name == "p8_ids" or len(rows) == len(set(rows)))
