import pytest

from codequarry.llm.docpairs import judge, pairs
from codequarry.llm.functions import extract
from codequarry.llm.gll import Recogniser
from codequarry.llm.handwritten import classify, notice, shape


def test_recogniser_takes_ambiguous_and_left_recursive_grammars():
    rules = {"S": [("S", "+", "S"), ("x",), ("(", "S", ")")], "L": [(), ("L", "x")]}
    r = Recogniser(rules, lambda symbol, token: symbol == token)
    assert r.ends("S", list("x+x+x"), 0) == {1, 3, 5} and r.ends("S", list("(x+x"), 0) == set() and r.ends("L", list("xxy"), 0) == {0, 1, 2}


def test_java_with_broken_parts():
    text = "class A {\n  /** Doc one. */\n  @Ann(a = \"x)\")\n  public List<Map<String, Long>> one(int a, final String... b) throws E { if (x) { y(); }\n  /** Two. */\n  void two() { }\n  int broken( { \n  /* no doc */\n  long three(int[] z);\n  /** Gone. */\n\n  void four() { }\n}"
    got = {f.name: f for f in extract(text, "A.java")}
    assert set(got) == {"one", "two", "three", "four"}
    assert (got["one"].doc, got["one"].line, got["one"].parameters, got["one"].return_type, got["one"].owner) == ("Doc one.", 4, ["int a", "final String... b"], "List<Map<String, Long>>", "A")
    assert got["two"].doc == "Two." and got["three"].doc is None and got["four"].doc is None


def test_scripts_and_python():
    ts = "export class B {\n  /**\n   * Doc.\n   * @param a thing\n   */\n  async run(a: string | null, b = { c: 1 }): Promise<void> {\n    if (a) { go(); }\n  }\n}\nfunction free(x) { return x; }"
    got = {f.name: f for f in extract(ts, "b.ts")}
    assert set(got) == {"run", "free"} and got["run"].doc.startswith("Doc.") and got["run"].return_type == "Promise<void>"
    py = "class A:\n    # note\n\n    @deco\n    def f(self, a: dict[str, int] = {}, *b) -> str | None:\n        '''Doc.'''\n        return 1\n\n    def g(self): pass\n"
    got = {f.name: f for f in extract(py, "a.py")}
    assert (got["f"].doc, got["f"].line, got["f"].owner, got["f"].return_type, got["f"].end_line) == ("Doc.", 5, "A", "str | None", 7) and got["g"].doc is None
    assert extract("x", "a.txt") == extract(None, "a.py") == extract("", "a.py") == []


@pytest.mark.parametrize("doc", [None, "", " \n", "-", "...", "tbd", "TODO: document this", "{@inheritDoc}", "(non-Javadoc)", "@param batch\n@return", "@since 1.4", "Loads the beacon.", "Method to load beacon.", "Load beacon function.\n@param batch the batch", "This method loads the beacon.\n@return the beacon", "Description of the method.", "Auto-generated method stub.", "--------", "loadBeacon", "@author platform", "Insert description"])
def test_trivial_documentation(doc):
    assert judge(doc, "loadBeacon", ["int batch"], "Beacon") == []


@pytest.mark.parametrize("doc", ["Not thread safe.", "Load beacon.\nSafe to call twice.", "@param batch rows per write", "Returns null instead of throwing."])
def test_telling_documentation(doc):
    assert judge(doc, "loadBeacon", ["int batch"], "Beacon")


def test_pairs_table(spark):
    text = "class A {\n  /** Not thread safe. */\n  void f() { }\n  /** F. */\n  void g() { }\n}"
    symbols = spark.createDataFrame([
        (1, "r", "p/A#f().", "f", "method", None, "A.java", 3, [], "void", "x"), (1, "r", "p/A#f().", "f", "method", None, "A.java", 3, [], "void", "x"), (2, "r", "p/A#g().", "g", "method", ["Not thread safe."], "A.java", 5, [], "void", "x"),
        (3, "r", "p/A#f().", "f", "method", [], "A.java", None, None, None, "x"), (4, "r", "p/B#h().", "h", "method", ["Safe to call twice."], "gone.java", 1, None, None, "x"), (5, "r", "p/B#i().", "i", "method", None, "gone.java", 1, None, None, "x"), (6, None, None, None, "method", None, None, None, None, None, "x"), (7, "r", "p/A#", "A", "class", ["Not thread safe."], "A.java", 1, None, None, "x"),
    ], "symbol_id long, repo_id string, symbol string, display_name string, kind string, documentation array<string>, file_path string, start_line int, parameters array<string>, return_type string, content string")
    files = spark.createDataFrame([("r", "A.java", text, 1), ("r", "A.java", text, 1), ("r", "gone.java", None, 1)], "repo_id string, file_path string, content string, says int")
    got = {r["symbol_id"]: r for r in pairs(symbols, files).collect()}
    assert set(got) == {1, 3, 4} and got[1]["code"] == "void f() { }" and got[4]["code"] is None
    assert pairs(symbols.limit(0), files).count() == 0


def test_templates_of_the_corpus_are_dropped(spark):
    rows = [(k, "r", f"p/A#run{c}().", f"runJob{c}", "method", [f"Nice runJob{c} indeed"], "x.java", 1, None, None) for k, c in enumerate("ABCDEFGH")] + [(99, "r", "p/A#q().", "runJobZ", "method", ["Wakes runJobZ at night"], "x.java", 1, None, None)]
    rows += [(100 + k, "r", "p/A#q().", f"go{c}", "method", ["Provides the default behaviour for this component."] + (["Not thread safe."] if c < "C" else []), "x.java", 1, None, None) for k, c in enumerate("ABCDEFGH")]
    symbols = spark.createDataFrame(rows, "symbol_id long, repo_id string, symbol string, display_name string, kind string, documentation array<string>, file_path string, start_line int, parameters array<string>, return_type string")
    files = spark.createDataFrame([], "repo_id string, file_path string, content string")
    kept = lambda **how: {r["symbol_id"] for r in pairs(symbols, files, **how).collect()}
    assert kept(least=5) == {99, 100, 101} and kept(least=5, share=0.5, named_share=0.5) == {r[0] for r in rows} == kept()
    assert kept(least=5, share=0.5) == {99, *range(100, 108)}


def test_broken_and_long_files():
    text = "class A {\n  /** First. */\n  void f() {\n    if (x) {\n  // note }\n  /** Second. */\n  public int g(int a) { return a; }\n}\n"
    f, g = extract(text, "A.java")
    assert (f.name, f.doc, f.end_line, text[f.start : f.end]) == ("f", "First.", 4, "void f() {\n    if (x) {") and (g.name, g.doc) == ("g", "Second.")
    one = "  /** Doc. */\n  void f(int a) {\n    call(\"}\", '{'); /* } */\n  }\n"
    assert len(extract("class A {\n" + one * 3000 + "}", "A.java")) == 3000
    py = "def f(a,\n      b):\n    'Doc.'\n    return (a,\nb)\n# tail\n\nasync def g():\n    return {1:\ndef h(): pass\n"
    assert [(x.name, x.line, x.end_line, x.doc) for x in extract(py, "a.py")] == [("f", 1, 5, "Doc."), ("g", 8, 9, None), ("h", 10, 11, None)]


def test_notices_and_remarks():
    assert notice("// Code generated by x. DO NOT EDIT.\npackage a;") == "generated" and notice("/*\n * Output of x 2.1 -- regenerate instead of editing\n */\nclass A {}") == "generated"
    assert notice("/*! Copied unchanged from lib 5.10.2, see upstream for history */") == "vendored" and notice("# lib v1.2 | (c) lib contributors | permissive licence") == "vendored"
    for text in ("// Keys are generated by the sequence; do not edit their order.\n", "# Template used by x to generate stubs, written by hand.\n", "class A {\n  /** Auto-generated method stub. */\n", "x = '@generated'\n", ""):
        assert notice(text) is None


def test_shapes():
    assert shape("!function(n){for(var n=0;n<63;n++)n(n)}(i);function k(d,g){return d?g.rank(d):86}" * 12) == "minified"
    assert shape("var T=[\n" + "0x3f,0xb6,0x8a,0x3a,0xfe,0xf2,0xcc,0xad,\n" * 30 + "];") == "data" and shape("id;name;score\n" + "91979;settlement;0.593;710679858\n" * 30) == "data"
    assert shape("// " + "long remark " * 60 + "\nclass A {\n" + "  void f() { return this.g(1); }\n" * 20 + "}") is None and shape("x") is None


def test_short_texts_have_a_shape():
    assert shape("!function(n,e){for(var t=0;t<e.length;t++)n[e[t]]=t;return n}({},['a','b','c']);var k=function(d){return d}") == "minified"
    assert shape("91979;4;0.593;710679858\n91980;7;0.112;710679859\n91981;9;0.733;710679860\n") == "data"
    for text in ("class A {\n  int f() { return 1; }\n}\n", "import { a } from './b';\n\nexport class C {\n}\n", "def f(a):\n    return a\n", "x = 1\ny = 2\nz = 3\n"):
        assert shape(text) is None


def test_paths(spark):
    rows = [("/a/node_modules/x/b.js", None, "vendored"), ("/a/vendors/onboarding/b.js", "x = 1", None), ("/a/external-api/client/b.py", None, None), ("/a/libs/lib-2.0.3/b.py", None, "vendored"), ("/a/x.min.js", None, "minified"), ("/a/gen/b.py", None, "generated"), ("/a/generator/b.py", "", None), ("/a/x_pb2.py", None, "generated"), ("/a/yarn.lock", None, "generated"), ("/a/gen2/src/main/java/com/x/gen/B.java", "", None), ("/a/build/generated/src/main/java/com/x/B.java", None, "generated"), ("/a/vendor", None, "vendored"), (None, "x", "-")]
    df = spark.createDataFrame([("r", p, c, w) for p, c, w in rows], "repo_id string, path string, content string, kind string")
    assert {r["path"]: r["kind"] for r in classify(df).collect()} == {p: w for p, _, w in rows if p}
    assert classify(df.limit(0)).count() == 0
