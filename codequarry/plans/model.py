"""A code graph of every kind of node and edge, derived from the commerce tables.

The project's own tables hold no inheritance, endpoints, policies or queries. So that the operators on these run over whole
tables of any size, parts are read as classes, line items as methods and fields, neighbouring items of an order as imports and
calls, nations as policies and suppliers as their violators. ``CTE`` is the same reading in SQL; what is computed on it is
written apart in either language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.detectors import CodeGraph
from codequarry.tables import cut, read

SUFFIXES = ("Service", "ServiceTest", "Handler", "Trigger", "Controller", "Repository", "Config", "Factory", "Dto", "Util", "Manager", "Client", "Job", "Base", "Spec", "")
VERBS = ("get", "set", "build", "loadAll", "saveAll", "runJob", "handleError", "catch", "findBy", "close", "open", "toString", "_hidden", "reject", "onError", "isReady", "destroy", "parse", "render", "emit")
EXTENSIONS = (".java", ".cls", ".ts", ".js")
AREAS = ("console", "ingestion", "mcp", "core", "core")


def _pick(values: tuple, index):
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def classes(spark: SparkSession, d: str) -> DataFrame:
    """repo_id, k, fqn, name, kind, package_fqn, module, file_path, annotations, modifiers, javadoc, start_line, end_line."""
    p = read(spark, d, "part", F.col("p_partkey").cast("long").alias("k"), "p_name", "p_brand", "p_type", "p_size")
    k = F.col("k")
    stem = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    name = F.concat(stem, F.when(k % 10 < 7, "").otherwise((k % 97).cast("string")), _pick(SUFFIXES, k % 16))
    package = F.concat(F.lit("org."), F.lower("p_type"), F.lit("."), F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("b")))
    kind = F.when(k % 16 == 3, "trigger").when(k % 9 == 0, "interface").when(k % 9 == 1, "enum").when(k % 9 == 2, "abstract_class").when(k % 9 == 3, "module").when(k % 9 == 4, "struct").otherwise("class")
    empty = F.array().cast("array<string>")
    annotations = F.when(k % 11 == 0, F.lit(None)).when(k % 8 == 0, F.array(F.lit("Deprecated"))).when(k % 8 == 1, F.array(F.lit("Service"), F.lit("Audited"))).otherwise(empty)
    modifiers = F.when(k % 12 == 0, F.array(F.lit("with sharing"))).when(k % 12 == 1, F.array(F.lit("public"))).otherwise(empty)
    doc = F.when(k % 3 == 0, F.lit(None)).when(k % 30 == 2, "Opens bolt:// connections").otherwise(F.concat(F.lit("About the "), "p_name"))
    path = F.concat(F.lit("/src/mod"), (k % 7).cast("string"), F.lit("/"), _pick(AREAS, k % 5), F.lit("/"), name, _pick(EXTENSIONS, k % 4))
    return p.select(
        F.concat(F.lit("r"), (k % 3).cast("string")).alias("repo_id"), "k", F.concat(package, F.lit(".k"), k.cast("string"), F.lit("."), name).alias("fqn"), name.alias("name"), kind.alias("kind"), package.alias("package_fqn"), F.concat(F.lit("mod"), (k % 7).cast("string")).alias("module"), path.alias("file_path"),
        annotations.alias("annotations"), modifiers.alias("modifiers"), doc.alias("javadoc"), F.lit(1).alias("start_line"), (F.col("p_size") * 12 + 1).cast("int").alias("end_line"),
    )


def _items(spark, d):
    return read(spark, d, "lineitem", F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("long").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def methods(spark: SparkSession, d: str) -> DataFrame:
    """repo_id, class_fqn, fqn, name, modifiers, annotations, docstring, file_path, start_line, end_line."""
    n, flag = F.col("n"), F.col("flag")
    access = F.when(flag == "A", "public").when(flag == "N", "private").otherwise("protected")
    # What repeated rows are told apart by are short columns, dealt out as the join needs them: one shuffle, without the words.
    own = _items(spark, d).select("k", "n", "q", access.alias("access"), F.coalesce((F.col("status") == "F") & (n == 1), F.lit(False)).alias("first")).repartition("k").distinct()
    name = _pick(VERBS, F.col("q") % 20)
    modifiers = F.array_compact(F.array("access", F.when(F.col("first"), "async"), F.when(n == 2, "virtual"), F.when(name == "destroy", "destructor")))
    own = own.select("k", "n", "q", name.alias("name"), modifiers.alias("modifiers"), F.when(n == 3, F.array(F.lit("Audited"))).otherwise(F.array().cast("array<string>")).alias("annotations"), F.when(n % 2 == 1, F.concat(F.lit("Does "), name)).alias("docstring"))
    c = classes(spark, d).select("k", "repo_id", F.col("fqn").alias("class_fqn"), "file_path")
    return own.join(c, "k").select("repo_id", "class_fqn", F.concat("class_fqn", F.lit("#"), "name").alias("fqn"), "name", "modifiers", "annotations", "docstring", "file_path", F.lit(1).alias("start_line"), (F.col("q") + 1).alias("end_line"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    """repo_id, class_fqn, name, type_name: the type is a list, a pointer, or the name of the class at half the key."""
    own = _items(spark, d).where("n = 7").select("k", "q", "flag").distinct()
    c = classes(spark, d).select("k", "repo_id", F.col("fqn").alias("class_fqn"))
    named = classes(spark, d).select(F.col("k").alias("half"), F.col("name").alias("half_name"))
    got = own.join(c, "k").withColumn("half", F.floor(F.col("k") / 2)).join(named, "half")
    return got.select("repo_id", "class_fqn", F.concat(F.lit("f"), F.col("q").cast("string")).alias("name"), F.when(F.col("flag") == "A", F.concat(F.lit("List<"), "half_name", F.lit(">"))).when(F.col("flag") == "N", "Node*").otherwise(F.col("half_name")).alias("type_name"))


def _neighbours(spark, d, low: int, high: int):
    a = _items(spark, d).where(f"q between {low} and {high}")
    b = _items(spark, d).select("o", (F.col("n") - 1).alias("n"), F.col("k").alias("k2"), F.col("q").alias("q2"))
    return a.join(b, ["o", "n"]).where("k <> k2 and k % 3 = k2 % 3")


def edges(spark: SparkSession, d: str, near: DataFrame | None = None, cls: DataFrame | None = None) -> DataFrame:
    """(repo_id, type, source, target): IMPORTS, EXTENDS and IMPLEMENTS between classes of one repository, each once.

    near: neighbouring items of all that ``edges`` and ``calls`` ask for, cls: the classes, where these were written.
    """
    k = F.col("k")
    j = F.floor(k / 3)
    own = read(spark, d, "part", F.col("p_partkey").cast("long").alias("k"))
    met = _neighbours(spark, d, 1, 9) if near is None else near.where("q between 1 and 9")
    imports = met.select(F.lit("IMPORTS").alias("type"), "k", "k2").distinct()
    extends = own.where((j >= 1) & (j % 5 != 0)).select(F.lit("EXTENDS").alias("type"), "k", (F.floor(j / 2) * 3 + k % 3).alias("k2"))
    implements = own.where("k % 7 = 3 and k % 3 = 0 and k % 9 <> 0").select(F.lit("IMPLEMENTS").alias("type"), "k", (F.floor(k / 9) * 9).alias("k2"))
    pairs = own.where("k % 27 = 3").select(F.lit("IMPORTS").alias("type"), "k", (k + 9).alias("k2"))
    imports = imports.unionByName(pairs).unionByName(pairs.select("type", F.col("k2").alias("k"), F.col("k").alias("k2"))).distinct()
    c = classes(spark, d) if cls is None else cls
    ends = c.select("k", "repo_id", F.col("fqn").alias("source")), c.select(F.col("k").alias("k2"), F.col("fqn").alias("target"))
    return imports.unionByName(extends).unionByName(implements).join(ends[0], "k").join(ends[1], "k2").select("repo_id", "type", "source", "target")


def calls(spark: SparkSession, d: str, near: DataFrame | None = None, cls: DataFrame | None = None) -> DataFrame:
    """(repo_id, caller, callee): calls between methods of different classes; near and cls as of ``edges``."""
    c = classes(spark, d) if cls is None else cls
    met = _neighbours(spark, d, 10, 15) if near is None else near.where("q between 10 and 15")
    pairs = met.select("k", "k2", _pick(VERBS, F.col("q") % 20).alias("a"), _pick(VERBS, F.col("q2") % 20).alias("b")).distinct()
    got = pairs.join(c.select("k", "repo_id", F.col("fqn").alias("s")), "k").join(c.select(F.col("k").alias("k2"), F.col("fqn").alias("t")), "k2")
    return got.select("repo_id", F.concat("s", F.lit("#"), "a").alias("caller"), F.concat("t", F.lit("#"), "b").alias("callee"))


def queried(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, source, target): methods that query a table."""
    own = _items(spark, d).where("q = 50").select("k", _pick(VERBS, F.col("q") % 20).alias("name"), F.when(F.col("flag") == "A", "ACCOUNT").otherwise("ORDERS").alias("target")).distinct()
    return own.join(classes(spark, d).select("k", "repo_id", "fqn"), "k").select("repo_id", F.concat("fqn", F.lit("#"), "name").alias("source"), "target")


def endpoints(spark: SparkSession, d: str, cls: DataFrame | None = None) -> DataFrame:
    """(repo_id, fqn, verb, path) of controllers; cls as of ``edges``."""
    return (classes(spark, d) if cls is None else cls).where("k % 16 = 4").select("repo_id", "fqn", F.when(F.col("k") % 3 == 0, "GET").otherwise("POST").alias("verb"), F.concat(F.lit("/"), F.lower("name"), F.when(F.col("k") % 32 == 4, "/{id}/items/{itemId:[0-9]+}").otherwise("")).alias("path"))


def policies(spark: SparkSession, d: str) -> DataFrame:
    """(policy_id, module, severity, status)."""
    n = F.col("n_nationkey")
    return read(spark, d, "nation", "n_nationkey", "n_regionkey").select(F.concat(F.lit("p"), n.cast("string")).alias("policy_id"), F.concat(F.lit("mod"), (n % 7).cast("string")).alias("module"), F.when(F.col("n_regionkey") == 0, "error").when(F.col("n_regionkey") == 1, "warning").otherwise("info").alias("severity"), F.when(n % 4 == 0, "draft").otherwise("active").alias("status"))


def violates(spark: SparkSession, d: str, cls: DataFrame | None = None) -> DataFrame:
    """(fqn, policy_id): what breaks a policy; cls as of ``edges``."""
    s = read(spark, d, "supplier", F.col("s_suppkey").cast("long").alias("k"), "s_nationkey")
    c = classes(spark, d) if cls is None else cls
    return s.join(c.select("k", "fqn"), "k").select("fqn", F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("policy_id"))


def graph(spark: SparkSession, d: str) -> CodeGraph:
    """All tables; the edges are written once, as several rules and every round of a closure read them."""
    return CodeGraph(classes(spark, d), methods(spark, d), fields(spark, d), cut(edges(spark, d)), calls(spark, d), queried(spark, d))


def import_graph(spark: SparkSession, d: str) -> CodeGraph:
    """What ``impact`` reads of ``graph``: classes, imports and calls; the rest isn't planned.

    Neighbouring items meet once, for imports and calls. Classes are written once, so that plans that read them stay short.
    """
    near = cut(_neighbours(spark, d, 1, 15).select("k", "k2", "q", "q2"))
    cls = cut(classes(spark, d).select("repo_id", "k", "fqn", "name", "module", "file_path", "annotations"))
    return CodeGraph(cls, None, None, cut(edges(spark, d, near, cls).where("type = 'IMPORTS'")), calls(spark, d, near, cls), None)


def _case(values: tuple, index: str) -> str:
    return "(ARRAY[" + ", ".join(f"'{v}'" for v in values) + f"])[{index} + 1]"


_NAME = "replace({stem}, ' ', '')".format(stem="array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")
CTE = f"""WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name, p_type, p_brand, p_size, {_NAME} || CASE WHEN p_partkey % 10 < 7 THEN '' ELSE CAST(p_partkey % 97 AS VARCHAR) END || {_case(SUFFIXES, "p_partkey % 16")} AS name FROM part),
cls AS (SELECT 'r' || k % 3 AS repo_id, k, 'org.' || lower(p_type) || '.' || replace(lower(p_brand), 'brand#', 'b') || '.k' || k || '.' || name AS fqn, name,
    CASE WHEN k % 16 = 3 THEN 'trigger' WHEN k % 9 = 0 THEN 'interface' WHEN k % 9 = 1 THEN 'enum' WHEN k % 9 = 2 THEN 'abstract_class' WHEN k % 9 = 3 THEN 'module' WHEN k % 9 = 4 THEN 'struct' ELSE 'class' END AS kind,
    'org.' || lower(p_type) || '.' || replace(lower(p_brand), 'brand#', 'b') AS package_fqn, 'mod' || k % 7 AS module, '/src/mod' || k % 7 || '/' || {_case(AREAS, "k % 5")} || '/' || name || {_case(EXTENSIONS, "k % 4")} AS file_path,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 8 = 0 THEN ['Deprecated'] WHEN k % 8 = 1 THEN ['Service', 'Audited'] ELSE CAST([] AS VARCHAR[]) END AS annotations,
    CASE WHEN k % 12 = 0 THEN ['with sharing'] WHEN k % 12 = 1 THEN ['public'] ELSE CAST([] AS VARCHAR[]) END AS modifiers,
    CASE WHEN k % 3 = 0 THEN NULL WHEN k % 30 = 2 THEN 'Opens bolt:// connections' ELSE 'About the ' || p_name END AS javadoc, p_size * 12 + 1 AS end_line FROM p),
item AS (SELECT l_orderkey AS o, CAST(l_partkey AS BIGINT) AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q, l_returnflag AS flag, l_linestatus AS status, {_case(VERBS, "CAST(l_quantity AS INT) % 20")} AS verb FROM lineitem),
mth AS (SELECT c.repo_id, c.fqn AS class_fqn, c.fqn || '#' || verb AS fqn, verb AS name, ms AS modifiers, an AS annotations, ds AS docstring, c.file_path, q + 1 AS end_line FROM (SELECT DISTINCT k, n, q, verb,
    list_filter([CASE flag WHEN 'A' THEN 'public' WHEN 'N' THEN 'private' ELSE 'protected' END, CASE WHEN status = 'F' AND n = 1 THEN 'async' END, CASE WHEN n = 2 THEN 'virtual' END, CASE WHEN verb = 'destroy' THEN 'destructor' END], lambda x: x IS NOT NULL) AS ms,
    CASE WHEN n = 3 THEN ['Audited'] ELSE CAST([] AS VARCHAR[]) END AS an, CASE WHEN n % 2 = 1 THEN 'Does ' || verb END AS ds FROM item) i JOIN cls c USING (k)),
fld AS (SELECT c.repo_id, c.fqn AS class_fqn, 'f' || q AS name, CASE flag WHEN 'A' THEN 'List<' || h.name || '>' WHEN 'N' THEN 'Node*' ELSE h.name END AS type_name FROM (SELECT DISTINCT k, q, flag FROM item WHERE n = 7) i JOIN cls c USING (k) JOIN cls h ON h.k = i.k // 2),
near AS (SELECT a.k, b.k AS k2, a.q, a.verb AS va, b.verb AS vb FROM item a JOIN item b ON a.o = b.o AND b.n = a.n + 1 WHERE a.k <> b.k AND a.k % 3 = b.k % 3),
ek AS (SELECT DISTINCT 'IMPORTS' AS type, k, k2 FROM (SELECT k, k2 FROM near WHERE q BETWEEN 1 AND 9 UNION ALL SELECT k, k + 9 FROM p WHERE k % 27 = 3 UNION ALL SELECT k + 9, k FROM p WHERE k % 27 = 3) UNION ALL SELECT 'EXTENDS', k, k // 3 // 2 * 3 + k % 3 FROM p WHERE k // 3 >= 1 AND k // 3 % 5 <> 0 UNION ALL SELECT 'IMPLEMENTS', k, k // 9 * 9 FROM p WHERE k % 7 = 3 AND k % 3 = 0 AND k % 9 <> 0),
edge AS (SELECT a.repo_id, type, a.fqn AS source, b.fqn AS target FROM ek JOIN cls a USING (k) JOIN cls b ON b.k = ek.k2),
call AS (SELECT a.repo_id, a.fqn || '#' || va AS caller, b.fqn || '#' || vb AS callee FROM (SELECT DISTINCT k, k2, va, vb FROM near WHERE q BETWEEN 10 AND 15) x JOIN cls a USING (k) JOIN cls b ON b.k = x.k2),
asked AS (SELECT DISTINCT c.repo_id, c.fqn || '#' || verb AS source, CASE flag WHEN 'A' THEN 'ACCOUNT' ELSE 'ORDERS' END AS target FROM item JOIN cls c USING (k) WHERE q = 50),
endpoint AS (SELECT repo_id, fqn, CASE WHEN k % 3 = 0 THEN 'GET' ELSE 'POST' END AS verb, '/' || lower(name) || CASE WHEN k % 32 = 4 THEN '/{{id}}/items/{{itemId:[0-9]+}}' ELSE '' END AS path FROM cls WHERE k % 16 = 4),
policy AS (SELECT 'p' || n_nationkey AS policy_id, 'mod' || n_nationkey % 7 AS module, CASE n_regionkey WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN n_nationkey % 4 = 0 THEN 'draft' ELSE 'active' END AS status FROM nation),
violate AS (SELECT c.fqn, 'p' || s_nationkey AS policy_id FROM supplier s JOIN cls c ON c.k = s.s_suppkey)
"""
