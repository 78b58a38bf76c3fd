"""Dependents to four hops for each package apart, and the risk with all of its terms."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from codequarry.operators import closure, impact, scoring
from codequarry.plans import model, wiring


def test_hops_three_and_four_by_package(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(9)] + [(3, 3), (1, 2)], "src long, dst long")
    changed = spark.createDataFrame([("a", 0), ("b", 3), ("b", 4), ("c", 9)], "package string, node long")
    got = {tuple(r) for r in closure.dependents_by(edges, changed, 4).select("package", "node", "hops").collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("b", 5, 1), ("b", 6, 2), ("b", 7, 3), ("b", 8, 4)}


def test_risk_has_four_terms(spark):
    rows = [(0, 0, 0, 0), (10, 0, 0, 0), (99, 99, 0, 0), (99, 99, 1, 0), (99, 99, 99, 99), (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "n int, m int, e int, p int").select(F.round(scoring.impact_risk(F.col("n"), F.col("m"), F.col("e"), F.col("p")), 4).alias("risk"))
    assert [r["risk"] for r in df.collect()] == [0.0, 0.2, 0.6, 0.7, 1.0, 0.2]


def test_components_share_what_they_follow_from(spark):
    """Each component reads what was written of the changed classes; none plans it anew."""
    found = wiring.change_components(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 15


def test_tests_of_one_name(spark):
    """Tests that share a name are each found by the class whose name it holds."""
    cls = spark.createDataFrame([("r", f"p.k{k}.RingTest", "RingTest", f"m{k}", "/t") for k in range(3)] + [("s", "p.RingTest", "RingTest", "m0", "/t"), ("r", "p.Other", "Other", "m9", "/o")], "repo_id string, fqn string, name string, module string, file_path string")
    g = SimpleNamespace(cls=cls)
    direct = spark.createDataFrame([("c", "r", "p.Ring"), ("d", "r", "p.R")], "change_id string, repo_id string, fqn string")
    modules = spark.createDataFrame([("c", "r", "m1"), ("e", "s", "m0")], "change_id string, repo_id string, module string")
    want = {(c, "r", f"p.k{k}.RingTest", "name-match") for c in "cd" for k in range(3)} | {("e", "s", "p.RingTest", "same-module")}
    assert {tuple(r) for r in impact._tests(g, direct, modules).collect()} == want


def test_items_meet_once_and_the_last_plan_is_small(spark, monkeypatch):
    """Neighbouring items are joined once for imports and calls, and what is written by steps leaves few joins to the last plan."""
    met = []
    own = model._neighbours
    monkeypatch.setattr(model, "_neighbours", lambda *a: met.append(a) or own(*a))
    found = wiring.change_components(spark, "/root/testdata/sf0.001")
    assert len(met) == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 5


def test_who_calls_and_imports(spark):
    """A class that imports and calls a changed one comes as both, at the least hops; changed ones only as such, repeated rows once."""
    cls = spark.createDataFrame([("r", f"p.{n}", n, "m", f"/{n}") for n in "ABCDE"] * 2, "repo_id string, fqn string, name string, module string, file_path string")
    edges = spark.createDataFrame([("r", "IMPORTS", "p.B", "p.A"), ("r", "IMPORTS", "p.B", "p.A"), ("r", "IMPORTS", "p.C", "p.B"), ("r", "IMPORTS", "p.A", "p.C"), ("r", "IMPORTS", "p.C", "p.A"), ("r", "EXTENDS", "p.E", "p.A")], "repo_id string, type string, source string, target string")
    calls = spark.createDataFrame([("r", "p.B#f", "p.A#f"), ("r", "p.B#g", "p.A#f"), ("r", "p.D#f", "p.A#g"), ("r", "p.A#g", "p.A#f")], "repo_id string, caller string, callee string")
    none = impact.Surroundings(spark.createDataFrame([], "repo_id string, fqn string, verb string, path string"), spark.createDataFrame([], "policy_id string, module string, severity string, status string"), spark.createDataFrame([], "fqn string, policy_id string"))
    changed = spark.createDataFrame([("c", "r", "/A")] * 2, "change_id string, repo_id string, file_path string")
    got = sorted((r["component"], r["key"], r["hops"]) for r in impact.components(SimpleNamespace(cls=cls, edges=edges, calls=calls), none, changed).collect())
    assert got == [("caller", "p.B", 1), ("caller", "p.D", 1), ("dependent", "p.B", 1), ("dependent", "p.C", 1), ("direct", "p.A", 0), ("module", "m", None)]


def test_classes_are_planned_once(spark):
    """What reads the classes reads those that were written: the last plan names no part's columns."""
    assert "p_name" not in wiring.change_components(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
