"""Queries that take all of their table, where others of their kind take ids by number."""

from codequarry.plans import reachability, warehouse
from codequarry.tables import read

FOLDER = "/root/testdata/sf0.001"


def test_every_brand_and_part_counts(spark):
    n = reachability.nodes(spark, FOLDER)
    got = reachability.QUERIES["dependents_4hop_by_brand"](spark, FOLDER)
    changed = n.join(reachability.edges(spark, FOLDER).where("src <> dst").selectExpr("dst as node"), "node", "left_semi").select("package").distinct()
    assert changed.count() > 1 and got.select("package").distinct().count() == changed.count()


def test_every_late_line_counts(spark):
    lines = {r["l_partkey"] for r in read(spark, FOLDER, "lineitem", "l_partkey", "l_shipdate").collect() if r["l_shipdate"].isoformat() >= "2001-09-01"}
    want = {r["p_partkey"] for r in read(spark, FOLDER, "part", "p_partkey").collect()} - lines
    assert want and lines
    assert {r["p_partkey"] for r in warehouse.QUERIES["parts_not_shipped_lately"](spark, FOLDER).collect()} == want
