"""Every core query that has SQL gives the same rows on the smallest tables."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

MODULES = [importlib.import_module(m) for m in entry.CORE]
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.SQL])
def test_same_as_sql(spark, name):
    queries = {n: f for m in MODULES for n, f in m.QUERIES.items()}
    sql = {n: s for m in MODULES for n, s in m.SQL.items()}
    compare(spark, queries[name], sql[name], FOLDER)


def test_every_sql_has_a_query():
    for m in MODULES:
        assert set(m.SQL) <= set(m.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo_id", "gap_start_ms", "gap_end_ms"]
