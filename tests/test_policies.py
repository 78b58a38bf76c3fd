import pytest

from codequarry.operators.policies import Graph, Rule, report, scan, violations
from codequarry.operators.wording import Sentence, compile_sentence


@pytest.mark.parametrize("text,want", [
    ("Services in 'web' module must not directly call 'store'", Sentence("path", "web", "store")), ("web module must not call store module.", Sentence("path", "web", "store")), ("the web layer must not depend on the store layer", Sentence("imports", "web", "store")), ("All classes in web module must have annotation @Traced", Sentence("annotated", "web", "Traced")),
    ("Controllers must not call repositories directly", Sentence("controllers")), ("Service classes must not extend Base", Sentence("extends", "", "Base")), ("all public methods in 'web' must be annotated with @Audited", Sentence("public", "web", "Audited")), ("", None), (None, None), ("gibberish {x} ; drop", None),
])
def test_phrasings(text, want):
    assert compile_sentence(text) == want


@pytest.fixture()
def g(spark):
    cls = spark.createDataFrame([("r", "com.web.A", "A", "com.web", "a.java", 1, 400, None, None), ("r", "com.web.B", "B", "com.web", "b.java", 1, 9, ["Traced"], "doc"), ("r", "com.x.A", "A", "com.x", "c.java", None, None, [], None)], "repo_id string, fqn string, name string, package_fqn string, file_path string, start_line int, end_line int, annotations array<string>, javadoc string")
    mth = spark.createDataFrame([("r", f"com.web.A#m{k}", f"m{k}", "com.web.A", ["public"], ["int a"], ["Deprecated"] if k == 0 else None, 1, 3, None) for k in range(31)], "repo_id string, fqn string, name string, class_fqn string, modifiers array<string>, parameters array<string>, annotations array<string>, start_line int, end_line int, docstring string")
    fld = spark.createDataFrame([("r", "com.web.B", "f", "Store<X>")], "repo_id string, class_fqn string, name string, type_name string")
    imports = spark.createDataFrame([("r", "a.java", "com.store.Repo"), ("r", "b.java", "com.storefront.Repo")], "repo_id string, file_path string, target string")
    return Graph(cls, mth, fld, imports)


def names(df):
    return {(r["violator"], r["detail"]) for r in df.collect()}


def test_rules(g):
    assert names(violations(g, Rule("many_methods", limit=30))) == {("com.web.A", "31")} and names(violations(g, Rule("many_methods", limit=31))) == set()
    assert names(violations(g, Rule("long_class", limit=300))) == {("com.web.A", "399")}
    assert names(violations(g, Rule("duplicate"))) == {("com.web.A", "A")}
    assert names(violations(g, Rule("no_import", "web", "store"))) == {("com.web.A", "com.store.Repo")}
    assert names(violations(g, Rule("needs_annotation", "", "Traced"))) == {("com.web.A", "Traced"), ("com.x.A", "Traced")}
    assert names(violations(g, Rule("deprecated_public"))) == {("com.web.A#m0", "deprecated")}
    assert len(names(violations(g, Rule("public_needs_annotation", "A", "Audited")))) == 31


def test_report_counts_all_and_samples_some(g):
    found = scan(g, (Rule("public_needs_annotation", "A", "Audited", severity="info"), Rule("many_methods", limit=30)))
    got = {r["policy"]: r for r in report(found).collect()}
    assert got["public_needs_annotation"]["n"] == 31 and got["public_needs_annotation"]["samples"].count(",") == 4 and got["many_methods"]["severity"] == "warning"
