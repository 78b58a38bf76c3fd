import pytest

from codequarry.operators import detectors, impact, wording
from codequarry.operators.detectors import CodeGraph

CLS = "repo_id string, fqn string, name string, kind string, package_fqn string, module string, file_path string, annotations array<string>, modifiers array<string>, javadoc string"
MTH = "repo_id string, class_fqn string, fqn string, name string, modifiers array<string>, annotations array<string>, docstring string"
FLD = "repo_id string, class_fqn string, name string, type_name string"
EDGE, CALL, ASKED = "repo_id string, type string, source string, target string", "repo_id string, caller string, callee string", "repo_id string, source string, target string"


def cls(name, package="p", kind="class", path=None, annotations=None, modifiers=None, doc="d", repo="r"):
    return (repo, f"{package}.{name}", name, kind, package, package, path or f"/{package}/{name}.java", annotations, modifiers, doc)


def graph(spark, classes=(), methods=(), fields=(), edges=(), calls=(), asked=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return CodeGraph(make(classes, CLS), make(methods, MTH), make(fields, FLD), make(edges, EDGE), make(calls, CALL), make(asked, ASKED))


def found(df):
    return sorted((r["policy"], r["violator"]) for r in df.collect())


def test_empty_tables_have_no_faults(spark):
    assert detectors.scan(graph(spark)).count() == 0


def test_null_columns_crash_nothing(spark):
    g = graph(spark, [("r", "p.A", "A", None, None, None, None, None, None, None), ("r", "p.B", None, "trigger", "p", None, "/b.cls", [None], [], ""), ("r", None, None, None, None, None, None, None, None, None)], [("r", "p.A", "p.A#m", None, None, None, None), ("r", None, None, "m", [None, "async"], [], None)], [("r", "p.A", None, None)], [("r", None, "p.A", None), ("r", "IMPORTS", None, "p.B"), ("r", "IMPORTS", "p.A", "p.B")], [("r", None, None)], [("r", None, "T")])
    assert {p for p, _ in found(detectors.scan(g))} <= set(detectors.DETECTORS)


def test_each_fault_once(spark):
    chain = [cls(f"C{k}", "deep") for k in range(8)]
    g = graph(
        spark,
        [*chain, cls("OrderService"), cls("OldThing", annotations=["Deprecated"]), cls("User", "q"), cls("Twin"), cls("Twin", "q"), cls("Shape", kind="struct"), cls("PayTrigger", kind="trigger"), cls("ShipTrigger", kind="trigger"), cls("ShipHandler"), cls("Ledger", path="/x/Ledger.cls", modifiers=[]), cls("Page", path="/x/page.js", doc=None), cls("a", "m", "module", "/m/a.js"), cls("b", "m", "module", "/m/b.js")],
        [("r", "p.Shape", "p.Shape#area", "area", ["virtual"], None, "x"), ("r", "p.Shape", "p.Shape#destroy", "destroy", ["destructor"], None, "x"), *[("r", "p.User", f"p.User#a{k}", f"a{k}", ["async"], None, "x") for k in range(4)]],
        [("r", "p.Shape", "raw", "Node*")],
        [*[("r", "EXTENDS", f"deep.C{k + 1}", f"deep.C{k}") for k in range(7)], ("r", "IMPORTS", "q.User", "p.OldThing"), ("r", "IMPORTS", "p.OrderService", "q.User"), ("r", "IMPORTS", "m.a", "m.b"), ("r", "IMPORTS", "m.b", "m.a")],
        [("r", "p.User#a0", "p.X#onError")],
        [("r", "p.Shape#area", "T")],
    )
    got = found(detectors.scan(g))
    of = lambda name: [v for p, v in got if p == name]
    assert of("deep-inheritance") == ["deep.C6", "deep.C7"] and of("service-no-interface") == ["p.OrderService"] and of("deprecated-with-callers") == ["p.OldThing"] and of("circular-deps") == ["p"]
    assert of("duplicate-class-names") == ["p.Twin"] and of("missing-virtual-destructor") == ["p.Shape"] == of("raw-pointer") and of("trigger-no-handler") == ["p.PayTrigger"] and of("missing-sharing") == ["p.Ledger"]
    assert of("class-missing-jsdoc") == ["p.Page"] and of("circular-imports") == ["m.a"] and of("async-no-error-handling") == ["p.User#a1", "p.User#a2", "p.User#a3"] and of("soql-risk") == ["p.Shape#area"] and of("large-packages") == []


@pytest.mark.parametrize("text,want", [("Services in 'p' module must not directly call 'q'", {"p.A", "p.B"}), ("p layer must not depend on q", {"p.B"}), ("Service classes must not extend Base", {"p.TheService"}), ("Controllers must not call repositories", {"p.AController"})])
def test_rules_in_words(spark, text, want):
    g = graph(spark, [cls("A"), cls("B"), cls("C", "q"), cls("TheService"), cls("Base"), cls("AController"), cls("BRepository")], edges=[("r", "IMPORTS", "p.B", "q.C"), ("r", "IMPORTS", "p.A", "p.B"), ("r", "EXTENDS", "p.TheService", "p.Base"), ("r", "EXTENDS", "p.A", "p.Base")], calls=[("r", "p.AController#x", "p.BRepository#y")])
    assert {r["violator"] for r in wording.run(g, {"x": text}).collect()} == want
    assert wording.run(graph(spark), {"x": text, "y": "nonsense"}).count() == 0


def test_impact_of_a_change(spark):
    classes = [cls(x, m) for x, m in (("A", "m1"), ("B", "m2"), ("C", "m3"), ("D", "m4"), ("E", "m5"), ("F", "m6"), ("G", "m7"), ("ATest", "m9"), ("OtherSpec", "m2"))]
    fqn = {c[2]: c[1] for c in classes}
    g = graph(spark, classes, edges=[("r", "IMPORTS", fqn[b], fqn[a]) for a, b in ("AB", "BC", "CD", "DE", "EF")], calls=[("r", fqn["G"] + "#x", fqn["A"] + "#y"), ("r", fqn["A"] + "#x", fqn["A"] + "#z")])
    around = impact.Surroundings(spark.createDataFrame([("r", fqn["A"], "GET", "/a")], "repo_id string, fqn string, verb string, path string"), spark.createDataFrame([("p1", "m2", "error", "active"), ("p2", "m2", "error", "draft"), ("p3", "m6", "error", "active")], "policy_id string, module string, severity string, status string"), spark.createDataFrame([("x", "p1")], "fqn string, policy_id string"))
    changed = spark.createDataFrame([("c", "r", "/m1/A.java"), ("c", "r", "/m1/A.java"), ("n", "r", "/none"), (None, None, None)], "change_id string, repo_id string, file_path string")
    got = {(r["component"], r["key"], r["hops"], r["detail"]) for r in impact.components(g, around, changed).collect()}
    assert got == {("direct", fqn["A"], 0, ""), ("caller", fqn["G"], 1, ""), *[("dependent", fqn[x], k + 1, "") for k, x in enumerate("BCDE")], ("endpoint", "GET /a", None, ""), *[("module", f"m{k}", None, "") for k in (1, 2, 3, 4, 5, 7)], ("policy", "p1", None, "error:violated"), ("test", fqn["ATest"], None, "name-match"), ("test", fqn["OtherSpec"], None, "same-module")}
    s = impact.summary(impact.components(g, around, changed)).collect()
    assert len(s) == 1 and s[0]["n_affected"] == 6 and s[0]["risk"] == pytest.approx(0.12 + 0.2 + 0.1 + 0.2)
    assert impact.components(g, around, changed.limit(0)).count() == 0
