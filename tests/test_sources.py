import json

from codequarry.sources import files
from codequarry.sources.facts import build_system, read_facts


def kinds(path, text, kind):
    return [f for f in read_facts(path, text) if f.kind == kind]


def test_java():
    text = '''package a.b;
import java.util.List;
@RestController @RequestMapping("/v1")
public abstract class Shop extends Base<String> implements Runnable, Other {
  private final Map<String, Long> store;
  private volatile boolean on;
  /* int fake() { } */
  public Shop() { }
  @GetMapping("/items/{id:[0-9]+}")
  public List<Item> find(@Valid String id, int n) throws IOException { return repo.load(id); }
  synchronized void run() { String s = "class Fake { void x() {} }"; }
  interface Inner { void go(); }
}
enum Color { RED }'''
    assert [(f.name, f.detail, f.owner) for f in kinds("X.java", text, "class")] == [("Shop", "abstract", ""), ("Inner", "interface", "Shop"), ("Color", "enum", "")]
    methods = {f.name: f for f in kinds("X.java", text, "method")}
    assert set(methods) == {"find", "run", "go"} and methods["find"].target == "List<Item>" and methods["find"].line == 10 and methods["go"].owner == "Inner"
    assert [f.name for f in kinds("X.java", text, "constructor")] == ["Shop"]
    edges = {(f.name, f.target) for f in kinds("X.java", text, "edge")}
    assert {("EXTENDS", "Base"), ("IMPLEMENTS", "Runnable"), ("IMPLEMENTS", "Other"), ("IMPORTS", "java.util.List"), ("CALLS", "repo#load")} <= edges
    assert {f.name for f in kinds("X.java", text, "field")} == {"store", "on"}
    assert [(f.name, f.target, f.detail) for f in kinds("X.java", text, "endpoint")] == [("GET /v1/items/{id:[0-9]+}", "find", "id")]
    assert {(f.detail, f.name) for f in kinds("X.java", text, "concurrency")} == {("volatile_field", "on"), ("synchronized_method", "run")}


def test_python():
    text = "import os\nfrom a.b import c\n\ndef top(): pass\n\nclass A(Base):\n    x: int = 1\n    @deco\n    async def m(self, a: int, *b) -> str:\n        return os.path.join(a)\n    class B:\n        pass\n"
    assert [(f.name, f.owner) for f in kinds("a.py", text, "class")] == [("<module>", ""), ("A", ""), ("B", "A")]
    assert [(f.name, f.owner, f.target) for f in kinds("a.py", text, "method")] == [("top", "<module>", ""), ("m", "A", "str")]
    assert {("IMPORTS", "", "os"), ("IMPORTS", "", "a.b.c"), ("CALLS", "A#m", "os.path#join")} <= {(f.name, f.owner, f.target) for f in kinds("a.py", text, "edge")}
    broken = kinds("a.py", "class A:\n    def m(self):\n        return (\nclass B:\n", "class")
    assert [f.name for f in broken] == ["A", "B"]


def test_scripts_markup_xml():
    text = "import { A, B as C } from './x';\nexport class Part extends Base {\n  @wire(getData, { objectApiName: 'Account' }) data;\n  run(a, b) { if (a) { return 1; } }\n  async go(): Promise<void> { }\n}\nfunction free() { }\n"
    assert [f.name for f in kinds("a.ts", text, "class")] == ["Part"]
    assert {(f.name, f.owner) for f in kinds("a.ts", text, "method")} == {("run", "Part"), ("go", "Part"), ("free", "<module>")}
    assert {(f.name, f.target) for f in kinds("a.ts", text, "edge")} >= {("IMPORTS", "./x#A"), ("IMPORTS", "./x#B"), ("EXTENDS", "Base"), ("CALLS", "getData"), ("QUERIES", "Account")}
    html = '<template if:true={x}><c-my-part onclick={go}></c-my-part><a href="/a">x</a><a href="#top">y</a><form action="/save"></form></template>'
    assert {(f.kind, f.target or f.name) for f in read_facts("a.html", html)} == {("edge", "c/myPart"), ("event", "click"), ("directive", "if:true"), ("link", "/a"), ("form", "/save")}
    flow = '<?xml version="1.0"?><Flow xmlns="http://x"><label>L</label><actionCalls><actionName>Act</actionName></actionCalls><recordLookups><object>Acc</object></recordLookups></Flow>'
    assert {(f.name, f.target) for f in kinds("a.xml", flow, "edge")} == {("CALLS", "Act"), ("QUERIES", "Acc")}
    perms = "<PermissionSet><classAccesses><apexClass>A</apexClass><enabled>true</enabled></classAccesses><classAccesses><apexClass>B</apexClass><enabled>false</enabled></classAccesses><fieldPermissions><field>A.x</field><readable>true</readable><editable>true</editable></fieldPermissions></PermissionSet>"
    assert [f.target for f in kinds("p.xml", perms, "edge")] == ["A"] and kinds("p.xml", perms, "annotation")[0].name == "@field(A.x:r+w)"
    assert kinds("p.xml", "<a><b></a>", "error")


def test_cpp_apex_abap():
    cpp = '#include "a/b.h"\nnamespace n { template <class T> class Box : public Base { public: int get() const; virtual ~Box(); }; struct P { int x; }; }\nint n::Box::get() const { std::mutex m; return 1; }\n'
    assert {(f.name, f.detail) for f in kinds("a.cpp", cpp, "class")} == {("n::Box", "template_class"), ("n::P", "struct")}
    assert ("EXTENDS", "Base") in {(f.name, f.target) for f in kinds("a.cpp", cpp, "edge")} and kinds("a.cpp", cpp, "concurrency")[0].detail == "mutex"
    apex = "public with sharing abstract class A extends B { public List<Account> all() { return [SELECT Id FROM Account]; } }\ntrigger T on Lead (before insert) { }"
    assert [(f.name, f.detail) for f in kinds("a.cls", apex, "class")] == [("A", "abstract_class"), ("T", "trigger")]
    assert {("QUERIES", "Account"), ("USES", "Lead"), ("EXTENDS", "B")} <= {(f.name, f.target) for f in kinds("a.cls", apex, "edge")}
    abap = "CLASS zcl_a DEFINITION ABSTRACT INHERITING FROM zcl_b.\nENDCLASS.\nCLASS zcl_a IMPLEMENTATION.\n METHOD run.\n  SELECT * FROM mara INTO TABLE t.\n  SELECT * FROM mara INTO TABLE t.\n  CALL FUNCTION 'Z_F'.\n ENDMETHOD.\nENDCLASS."
    assert kinds("a.abap", abap, "class")[0].detail == "abstract"
    assert [(f.name, f.target) for f in kinds("a.abap", abap, "edge")] == [("EXTENDS", "ZCL_B"), ("QUERIES", "MARA"), ("CALLS", "Z_F")]


def test_other_files_have_no_facts():
    assert read_facts("a.bin", "x") == read_facts("noext", "x") == read_facts("a.java", None) == read_facts("a.java", "") == []


def test_discover_and_transcripts(spark, tmp_path):
    for name, text in (("src/A.java", "class A {}"), ("node_modules/x.js", "1"), ("src/b.txt", "no"), ("src/deep/c.py", "x = 1")):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = files.discover(spark, f"file:{tmp_path}/tree")
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in got.collect()) == ["A.java", "c.py"]
    assert got.count() == files.near_in_time(got, got["modified"]).count()
    (tmp_path / "t").mkdir()
    (tmp_path / "t/good.jsonl").write_text(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}) + "\n\n")
    (tmp_path / "t/bad.jsonl").write_text('{"timestamp": "x"}\n{oops\n')
    rows = files.transcripts(spark, f"{tmp_path}/t").select("record.message.role").collect()
    assert [r["role"] for r in rows] == ["user"]
    (tmp_path / "r.json").write_text('{"a": "/x",\n "b": "/y"}')
    assert {tuple(r) for r in files.registry(spark, f"{tmp_path}/r.json").collect()} == {("a", "/x"), ("b", "/y")}


def test_build_system(spark):
    rows = [("a", "/a/pom.xml"), ("a", "/a/build.gradle"), ("b", "/b/setup.py"), ("c", "/c/x.c")]
    assert {tuple(r) for r in build_system(spark.createDataFrame(rows, "repo_id string, path string")).collect()} == {("a", "gradle"), ("b", "python"), ("c", "unknown")}


def test_resource_endpoints():
    from codequarry.sources.facts import read_facts

    text = '@Path("/orders")\npublic class A {\n  @GET @Path("{id}/items/{item: \\\\d+}")\n  public Item one(@PathParam("id") int id) { return null; }\n  @Path("x") @POST\n  Item two();\n  // @DELETE void no() {}\n  @PUT\n  public void three() { }\n}\n'
    got = [(f.name, f.owner, f.target, f.detail) for f in read_facts("A.java", text) if f.kind == "endpoint"]
    assert [x[0].split()[0] for x in got] == ["GET", "POST", "PUT"] and [x[2] for x in got] == ["one", "two", "three"] and got[0][0].startswith("GET /orders/{id}/items/") and got[0][3].startswith("id,item") and got[1][0] == "POST /orders/x" and got[2][0] == "PUT /orders"


def test_fields_by_themselves_and_of_trigger_code():
    from codequarry.sources.facts import read_facts

    text = '<CustomField xmlns="x"><fullName>Owner__c</fullName><type>Lookup</type><referenceTo>User</referenceTo></CustomField>'
    got = read_facts("objects/Account/fields/Owner__c.field-meta.xml", text)
    assert [(f.kind, f.name, f.owner, f.target) for f in got] == [("field", "Owner__c", "Account", "Lookup"), ("edge", "REFERENCES", "Account.Owner__c", "User")]
    assert ("field", "total", "A", "Integer") in [(f.kind, f.name, f.owner, f.target) for f in read_facts("A.cls", "public with sharing class A { private Integer total = 0; void f() { } }")]
    found = [(f.name, f.detail) for f in read_facts("a.cpp", "#include <x>\nstd::mutex a;\nstd::mutex b;\nstd::async(f);\nstd::async(g);\n") if f.kind == "concurrency"]
    assert found == [("std::mutex", "mutex"), ("std::mutex", "mutex"), ("std::async", "async")]


def test_modules_by_the_first_stage(spark):
    from codequarry.sources import layout

    rows = [("a", "/a/x/build.gradle"), ("a", "/a/y/pom.xml"), ("b", "/b/p/__init__.py"), ("b", "/b/p/q/__init__.py"), ("b", "/b/services/s/f.py"), ("c", "/c/apps/web/src/i.js"), ("c", "/c/readme.md"), ("c", None), ("d", "/d/f.py")]
    df = spark.createDataFrame(rows * 2, "repo_id string, path string")
    assert {tuple(r) for r in layout.modules(df).collect()} == {("a", "/a/x", "gradle"), ("b", "/b/p", "python"), ("c", "/c/apps/web", "services")}
    assert layout.modules(df.limit(0)).count() == 0


def test_routes(spark):
    from codequarry.sources import layout

    text = "import x\n\n@app.get('/a/{id}')\ndef one(id):\n    return render('pages/one.html', id=id)\n\n@bp.route('/b/<int:k>')\ndef two(k):\n    pass\n"
    df = spark.createDataFrame([("a.py", text), ("b.py", None), ("c.py", "")], "path string, content string")
    assert [tuple(r) for r in layout.routes(df).collect()] == [("a.py", "GET", "/a/{id}", "one", ["id"], "pages/one.html"), ("a.py", "GET", "/b/<int:k>", "two", ["k"], "")]
