"""Scores of all four dimensions against values worked out by hand or by a plain loop."""

import pytest
from pyspark.sql import functions as F

from codequarry import graph
from codequarry.operators import scoring
from codequarry.plans import code

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def scored(spark):
    """r: Base is imported by U0 to U120 (U0 by T alone as well); UTest is a test. q: the same name without any edge."""
    names = [("r", "p.Base", "Base", "doc")] + [("r", f"p.U{k}", f"U{k}", "doc") for k in range(121)] + [("r", "p.T", "T", None), ("r", "p.UTest", "UTest", None), ("q", "p.Base", "Base", None)]
    cls = spark.createDataFrame([(r, f, n, "p", f"/{n}.java", 1, 9, [], doc) for r, f, n, doc in names], "repo_id string, fqn string, name string, package_fqn string, file_path string, start_line int, end_line int, annotations array<string>, javadoc string")
    mth = spark.createDataFrame([("r", "p.Base")] + [("q", "p.Base")] * 25, "repo_id string, class_fqn string")
    fld = spark.createDataFrame([], "repo_id string, class_fqn string")
    edges = spark.createDataFrame([("r", f"p.U{k}", "p.Base") for k in range(121)] + [("r", "p.T", "p.U0")], "repo_id string, source string, target string")
    return scoring.whole_scores(scoring.enriched(cls, mth, fld, edges))


def test_blast_and_coupling_count(scored):
    got = {(r["repo_id"], r["fqn"]): r for r in scored.collect()}
    base = got["r", "p.Base"]
    # fan-in 121 of 121: coupling .5 + .25 / 50; 122 depend on it, p.T over p.U0
    assert (base["blast_size"], base["coupling"], base["tier"]) == (122, 0.505, "god")
    assert (base["size_score"], base["blast_score"], base["coupling_score"], base["docs_score"], base["score"], base["grade"]) == (25, 0, 0, 25, 50, "C")
    assert base["warnings"] == ["Large blast radius — 122 classes affected by signature changes"]
    assert base["reasons"] == ["high:god_class", "high:high_blast", "medium:high_coupling"] and base["benefit"] == round(50 * 10 * (1 + 122 * 0.05) * 1.6, 1)
    alone = got["q", "p.Base"]  # 25 methods, no edges: coupling .125
    assert (alone["coupling"], alone["score"], alone["grade"], alone["tier"], alone["reasons"], alone["benefit"]) == (0.125, 10 + 25 + 20, "C", "medium", ["medium:missing_docs", "low:too_many_methods"], 90.0)
    assert got["r", "p.UTest"]["role"] == "TEST" and got["r", "p.T"]["score"] == 25 + 25 + got["r", "p.T"]["coupling_score"]


def test_repo_means_leave_tests_out(scored):
    rows = [r for r in scored.collect() if r["repo_id"] == "r"]
    own = [r["score"] for r in rows if r["role"] != "TEST"]
    got = {r["repo_id"]: r for r in scoring.whole_repo_scores(scored).collect()}
    r = got["r"]
    assert (r["n_classes"], r["n_scored"], r["n_god"], r["penalty"], r["score"]) == (124, 123, 1, 0, round(sum(own) / len(own), 1))
    cost = lambda s: 500 if s >= 80 else 900 if s >= 60 else 1750 if s >= 40 else 3500 if s >= 20 else 7500
    assert r["tokens"] == sum(map(cost, own)) and r["saving_to_b"] == sum(cost(s) - 900 for s in own if s < 65)
    assert [d["lost"] for d in r["dims"]] == sorted((d["lost"] for d in r["dims"]), reverse=True) and {d["name"]: d["affected"] for d in r["dims"]} == {"Documentation": 1, "Class size": 0, "Blast radius": 1, "Coupling": 123 - sum(x["coupling"] < 0.2 for x in rows if x["role"] != "TEST")}
    assert (got["q"]["score"], got["q"]["tokens"], got["q"]["assisted_score"]) == (55.0, 1750, 55.0)


def test_no_class_scored(spark, scored):
    r = scoring.whole_repo_scores(scored.where("role = 'TEST'")).first()
    assert (r["n_scored"], r["score"], r["grade"], r["tokens"]) == (0, 0.0, "F", 0)


def test_class_edges(spark):
    cls = spark.createDataFrame([("r", "p.A", "A", "a"), ("r", "p.B", "B", "b"), ("r", "q.C", "C", "c"), ("r", "p.C", "C", "d"), ("s", "p.B", "B", "b")], "repo_id string, fqn string, name string, file_path string")
    facts = spark.createDataFrame(
        [("r", "a", "edge", "IMPORTS", "", "p.B"), ("r", "a", "edge", "IMPORTS", "", "p.B"), ("r", "a", "edge", "IMPORTS", "", "java.X"), ("r", "a", "edge", "IMPORTS", "", "q.C"), ("r", "a", "edge", "EXTENDS", "A", "C"), ("r", "b", "edge", "EXTENDS", "B", "A"), ("r", "b", "edge", "EXTENDS", "B", "C"), ("s", "b", "edge", "EXTENDS", "B", "A"), ("r", "a", "edge", "CALLS", "A", "C")],
        "repo_id string, path string, kind string, name string, owner string, target string",
    )
    assert {tuple(r) for r in graph.class_edges(facts, cls).collect()} == {("r", "p.A", "p.B"), ("r", "p.A", "q.C"), ("r", "p.B", "p.A")}


def test_queries_agree(spark):
    rows = code.hygiene_class(spark, FOLDER).select("repo_id", "fqn", "grade", "tier", "role").collect()
    assert len(rows) == code._cls(spark, FOLDER).select("repo_id", "fqn").distinct().count()
    assert sum(r["n_classes"] for r in code.hygiene_repo(spark, FOLDER).collect()) == len(rows)
    assert code.hygiene_grouping_sets(spark, FOLDER).where(F.col("repo_id").isNull()).first()["n"] == len(rows)
    assert sum(r["n_tiny"] for r in code.tier_pivot(spark, FOLDER).collect()) == sum(r["tier"] == "tiny" for r in rows)
