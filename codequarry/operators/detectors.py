"""Detectors of architectural faults: each is a plan over the tables of a code graph and gives (repo_id, violator, detail).

All detectors share that schema, so a scan is their union and one aggregation makes the report. Counts are of all violators;
a limit is only set on the samples of a report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators import closure
from codequarry.tables import cut


@dataclass
class CodeGraph:
    """Tables of a code base, each with repo_id.

    cls: fqn, name, kind, package_fqn, module, file_path, annotations, modifiers, javadoc; mth: class_fqn, fqn, name, modifiers,
    docstring; fld: class_fqn, type_name; edges: type, source, target between classes; calls: caller, callee between methods;
    queried: source, target, the tables that methods query; exhibits: fqn, pattern, severity, the anti-patterns that classes show.
    """

    cls: DataFrame
    mth: DataFrame
    fld: DataFrame
    edges: DataFrame
    calls: DataFrame
    queried: DataFrame
    exhibits: DataFrame | None = None
    limits: dict[str, int] = field(default_factory=dict)

    def of(self, *types: str) -> DataFrame:
        """(repo_id, source, target) of edges of these types."""
        return self.edges.where(F.col("type").isin(*types)).select("repo_id", "source", "target").distinct()

    @cached_property
    def blast(self) -> DataFrame:
        """(repo_id, fqn, blast_size), written once: how many classes depend on each, 500 standing for more."""
        key = lambda c: F.struct("repo_id", F.col(c).alias("fqn"))
        sizes = closure.blast_sizes(self.of("IMPORTS", "EXTENDS", "IMPLEMENTS").select(key("source").alias("src"), key("target").alias("dst")))
        return cut(sizes.select("node.repo_id", "node.fqn", F.col("size").alias("blast_size")))

    def limit(self, name: str, default: int) -> int:
        return self.limits.get(name, default)


# Kinds that count as classes of a compiled language, suffixes of scripts, words of handlers and of drivers, names that
# may come twice.
NATIVE_KINDS = ("class", "struct", "template_class")
SCRIPTS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
SHARING = ("with sharing", "without sharing", "inherited sharing")
CATCHERS = ("catch", "reject", "handleerror", "onerror")
ALLOWED_NAMES = ("Config", "Settings", "Meta", "Router", "main", "app", "log", "logger", "client", "handler")
DRIVER_WORDS, DRIVER_NAME = ("neo4j", "GraphDatabase", "bolt://"), "neo4j"


def _no_test(c: Column, lower: bool = True) -> Column:
    return ~c.contains("Test") & ~c.contains("test") if lower else ~c.contains("Test")


def _has(c: str, value: str) -> Column:
    return F.coalesce(F.array_contains(c, value), F.lit(False))


def _deprecated(c: str = "annotations") -> Column:
    return F.coalesce(F.exists(c, lambda a: a.contains("Deprecated")), F.lit(False))


def _out(df: DataFrame, violator: str | Column = "fqn", detail: Column | None = None) -> DataFrame:
    v = F.col(violator) if isinstance(violator, str) else violator
    return df.select("repo_id", v.alias("violator"), (F.lit("") if detail is None else detail.cast("string")).alias("detail")).distinct()


def antipattern(g: CodeGraph) -> DataFrame:
    """Classes that show a pattern marked as bad; it brings its own severity."""
    if g.exhibits is None:
        return g.cls.limit(0).select("repo_id", F.col("fqn").alias("violator"), F.lit("").alias("detail"))
    return _out(g.exhibits, "fqn", F.col("pattern"))


def circular_packages(g: CodeGraph) -> DataFrame:
    """Pairs of packages of which classes import one another's, the smaller name first."""
    package = g.cls.select("repo_id", "fqn", "package_fqn").distinct()
    ends = g.of("IMPORTS").join(package.select("repo_id", F.col("fqn").alias("source"), F.col("package_fqn").alias("a")), ["repo_id", "source"]).join(package.select("repo_id", F.col("fqn").alias("target"), F.col("package_fqn").alias("b")), ["repo_id", "target"])
    pairs = ends.where("a <> b").select("repo_id", "a", "b").distinct()
    both = pairs.where("a < b").join(pairs.where("a > b").select("repo_id", F.col("a").alias("b"), F.col("b").alias("a")), ["repo_id", "a", "b"], "left_semi")
    return _out(both, F.col("a"), F.col("b"))


def deep_inheritance(g: CodeGraph) -> DataFrame:
    """Classes six or more steps below a root of EXTENDS."""
    key = lambda c: F.struct("repo_id", F.col(c).alias("fqn"))
    depth = closure.depth_to_root(g.of("EXTENDS").select(key("source").alias("src"), key("target").alias("dst"))).where(F.col("depth") >= g.limit("depth", 6))
    return _out(depth.select("node.repo_id", "node.fqn", "depth"), "fqn")


def untested_package(g: CodeGraph) -> DataFrame:
    """Packages of three or more production classes without a test."""
    fqn, name = F.col("fqn"), F.col("name")
    test = fqn.contains("Test") | name.endswith("Test") | name.endswith("Tests")
    own = g.cls.where(~F.col("package_fqn").contains("test")).groupBy("repo_id", "package_fqn").agg(F.count_if(_no_test(fqn)).alias("n"), F.count_if(test).alias("t"))
    return _out(own.where((F.col("n") >= g.limit("package_classes", 3)) & (F.col("t") == 0)), "package_fqn", F.col("n"))


def large_package(g: CodeGraph) -> DataFrame:
    n = g.cls.groupBy("repo_id", "package_fqn").agg(F.count("*").alias("n"))
    return _out(n.where(F.col("n") > g.limit("large_package", 50)), "package_fqn", F.col("n"))


def service_without_interface(g: CodeGraph) -> DataFrame:
    own = g.cls.where(F.col("name").endswith("Service") & _no_test(F.col("fqn"), False))
    return _out(own.join(g.of("IMPLEMENTS").select("repo_id", F.col("source").alias("fqn")), ["repo_id", "fqn"], "left_anti"))


def deprecated_with_callers(g: CodeGraph) -> DataFrame:
    """Deprecated classes that others, neither deprecated nor tests, import."""
    old = g.cls.where(_deprecated()).select("repo_id", F.col("fqn").alias("target"))
    users = g.cls.where(~_deprecated() & _no_test(F.col("fqn"), False)).select("repo_id", F.col("fqn").alias("source"))
    n = g.of("IMPORTS").join(old, ["repo_id", "target"]).join(users, ["repo_id", "source"]).groupBy("repo_id", "target").agg(F.count("*").alias("n"))
    return _out(n, "target", F.col("n"))


def _reached(g: CodeGraph, least: int) -> DataFrame:
    return g.cls.where(_no_test(F.col("fqn")) & (F.col("kind") != "module")).join(g.blast.where(F.col("blast_size") >= least), ["repo_id", "fqn"])


def undocumented_high_blast(g: CodeGraph) -> DataFrame:
    return _out(_reached(g, g.limit("blast", 5)).where("javadoc is null"), "fqn", F.col("blast_size"))


def undocumented_module(g: CodeGraph) -> DataFrame:
    return _out(g.cls.where("kind = 'module' and javadoc is null"))


def undocumented_core_method(g: CodeGraph) -> DataFrame:
    """Methods without a comment, names with a leading underscore aside, of classes that three or more depend on."""
    m = g.mth.where("docstring is null and not startswith(name, '_')").select("repo_id", F.col("class_fqn").alias("fqn"), "name").distinct()
    return _out(m.join(_reached(g, g.limit("core", 3)).select("repo_id", "fqn").distinct(), ["repo_id", "fqn"]), F.concat("fqn", F.lit("#"), "name"))


def _import_ends(g: CodeGraph) -> DataFrame:
    side = lambda end: g.cls.select("repo_id", F.col("fqn").alias(end), F.col("file_path").alias(f"{end}_path"))
    return g.of("IMPORTS").join(side("source"), ["repo_id", "source"]).join(side("target"), ["repo_id", "target"])


def layer_import(g: CodeGraph, upper: str = "/console/", lower: str = "/ingestion/") -> DataFrame:
    return _out(_import_ends(g).where(F.col("source_path").contains(upper) & F.col("target_path").contains(lower)), "source", F.col("target"))


def driver_import(g: CodeGraph, area: str = "/mcp/") -> DataFrame:
    """Classes of an area that name a database driver or import it: the union of two probes."""
    doc = F.coalesce("javadoc", F.lit(""))
    named = g.cls.where(F.col("file_path").contains(area) & (F.col("fqn").contains(DRIVER_NAME) | reduce(lambda a, b: a | b, (doc.contains(w) for w in DRIVER_WORDS))))
    imported = _import_ends(g).where(F.col("source_path").contains(area) & (F.col("target").contains(DRIVER_NAME) | F.col("target_path").contains(DRIVER_NAME)))
    return _out(named).unionByName(_out(imported, "source")).distinct()


def duplicate_name(g: CodeGraph) -> DataFrame:
    """Names that two or more classes of a repository bear, with the first of them."""
    own = g.cls.where(_no_test(F.col("fqn")) & (F.col("kind") != "module") & ~F.col("name").isin(*ALLOWED_NAMES))
    n = own.groupBy("repo_id", "name").agg(F.countDistinct("fqn").alias("n"), F.min("fqn").alias("fqn")).where("n > 1")
    return _out(n, "fqn", F.col("n"))


def missing_virtual_destructor(g: CodeGraph) -> DataFrame:
    m = g.mth.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.bool_or(_has("modifiers", "virtual")).alias("virtual"), F.bool_or(_has("modifiers", "virtual") & _has("modifiers", "destructor")).alias("safe"))
    own = g.cls.where(F.col("kind").isin(*NATIVE_KINDS) & _no_test(F.col("fqn"), False))
    return _out(own.join(m.where("virtual and not safe"), ["repo_id", "fqn"], "left_semi"))


def raw_pointer(g: CodeGraph) -> DataFrame:
    """Native classes with a destructor and a field of a pointer type."""
    d = g.mth.where(_has("modifiers", "destructor")).select("repo_id", F.col("class_fqn").alias("fqn"))
    f = g.fld.where(F.col("type_name").endswith("*") | F.col("type_name").contains("* ")).select("repo_id", F.col("class_fqn").alias("fqn"))
    own = g.cls.where(F.col("kind").isin(*NATIVE_KINDS) & _no_test(F.col("fqn"), False))
    return _out(own.join(d, ["repo_id", "fqn"], "left_semi").join(f, ["repo_id", "fqn"], "left_semi"))


def include_chain(g: CodeGraph) -> DataFrame:
    n = g.of("IMPORTS").groupBy("repo_id", F.col("source").alias("fqn")).agg(F.count("*").alias("n")).where(F.col("n") > g.limit("includes", 30))
    own = g.cls.where(F.col("kind").isin(*NATIVE_KINDS, "module")).select("repo_id", "fqn")
    return _out(n.join(own, ["repo_id", "fqn"], "left_semi"), "fqn", F.col("n"))


def trigger_without_handler(g: CodeGraph) -> DataFrame:
    """Triggers without a class of their name and Handler or TriggerHandler, and without a handler whose stem begins theirs.

    The stems are looked up by all prefixes of the trigger's name, so no trigger is held against every handler.
    """
    t = g.cls.where("kind = 'trigger'").select("repo_id", "fqn", "name").distinct()
    names = g.cls.select("repo_id", "name").distinct()
    before = names.where("endswith(name, 'Handler')").select("repo_id", F.split_part("name", F.lit("Handler"), F.lit(1)).alias("prefix")).distinct()
    either = F.array(F.concat("name", F.lit("Handler")), F.concat("name", F.lit("TriggerHandler")))
    exact = t.select("repo_id", "fqn", F.explode(either).alias("handler")).join(names.select("repo_id", F.col("name").alias("handler")), ["repo_id", "handler"], "left_semi").select("repo_id", "fqn")
    prefixes = t.select("repo_id", "fqn", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring("name", F.lit(1), n))).alias("prefix"))
    by_prefix = prefixes.join(before, ["repo_id", "prefix"], "left_semi").select("repo_id", "fqn")
    return _out(t.join(exact.unionByName(by_prefix).distinct(), ["repo_id", "fqn"], "left_anti"))


def query_risk(g: CodeGraph) -> DataFrame:
    """Methods that query a table."""
    m = g.mth.select("repo_id", "fqn").distinct()
    return _out(m.join(g.queried.select("repo_id", F.col("source").alias("fqn")), ["repo_id", "fqn"], "left_semi"))


def missing_sharing(g: CodeGraph) -> DataFrame:
    shared = F.arrays_overlap(F.coalesce("modifiers", F.array().cast("array<string>")), F.array(*map(F.lit, SHARING)))
    return _out(g.cls.where(F.col("kind").isin("class", "abstract_class") & F.col("file_path").endswith(".cls") & ~shared & _no_test(F.col("fqn"), False)))


def async_without_handling(g: CodeGraph) -> DataFrame:
    """Asynchronous methods that call nothing which handles errors; of fewer than three in a repository none counts."""
    caught = g.calls.where(F.lower(F.substring_index("callee", "#", -1)).isin(*CATCHERS)).select("repo_id", F.col("caller").alias("fqn"))
    m = g.mth.where(_has("modifiers", "async")).select("repo_id", "fqn").distinct().join(caught, ["repo_id", "fqn"], "left_anti")
    enough = m.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") >= g.limit("async", 3))
    return _out(m.join(enough, "repo_id", "left_semi"))


def _script(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col("file_path").endswith(x) for x in SCRIPTS)))


def undocumented_script_class(g: CodeGraph) -> DataFrame:
    own = _script(g.cls).where("kind in ('class', 'module') and coalesce(javadoc, '') = '' and not endswith(name, 'Test') and not endswith(name, 'Spec')")
    return _out(own)


def large_module(g: CodeGraph) -> DataFrame:
    n = g.mth.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n")).where(F.col("n") > g.limit("module_methods", 20))
    return _out(_script(g.cls).where("kind = 'module'").join(n, ["repo_id", "fqn"]), "fqn", F.col("n"))


def circular_modules(g: CodeGraph) -> DataFrame:
    """Pairs of modules that import each other."""
    module = g.cls.where("kind = 'module'").select("repo_id", "fqn").distinct()
    own = g.of("IMPORTS").join(module.withColumnRenamed("fqn", "source"), ["repo_id", "source"], "left_semi").join(module.withColumnRenamed("fqn", "target"), ["repo_id", "target"], "left_semi")
    both = own.where("source < target").join(own.where("source > target").select("repo_id", F.col("source").alias("target"), F.col("target").alias("source")), ["repo_id", "source", "target"], "left_semi")
    return _out(both, "source", F.col("target"))


#: Every detector with its severity, in the order in which they report.
DETECTORS: dict[str, tuple[str, Callable[[CodeGraph], DataFrame]]] = {
    "antipattern": ("warning", antipattern), "circular-deps": ("error", circular_packages), "deep-inheritance": ("warning", deep_inheritance), "untested-packages": ("warning", untested_package), "large-packages": ("warning", large_package), "service-no-interface": ("warning", service_without_interface),
    "deprecated-with-callers": ("warning", deprecated_with_callers), "undocumented-high-blast": ("warning", undocumented_high_blast), "undocumented-module": ("warning", undocumented_module), "undocumented-core-method": ("warning", undocumented_core_method), "layer-import": ("error", layer_import), "driver-import": ("error", driver_import),
    "duplicate-class-names": ("warning", duplicate_name), "missing-virtual-destructor": ("error", missing_virtual_destructor), "raw-pointer": ("warning", raw_pointer), "include-chains": ("warning", include_chain), "trigger-no-handler": ("warning", trigger_without_handler), "soql-risk": ("warning", query_risk), "missing-sharing": ("warning", missing_sharing),
    "async-no-error-handling": ("warning", async_without_handling), "class-missing-jsdoc": ("info", undocumented_script_class), "large-module": ("warning", large_module), "circular-imports": ("error", circular_modules),
}


def scan(g: CodeGraph, chosen: tuple[str, ...] | None = None) -> DataFrame:
    """(policy, severity, repo_id, violator, detail) of the chosen detectors, all by default. An anti-pattern has its own severity."""
    names = chosen or tuple(DETECTORS)
    parts = []
    for name in names:
        severity, find = DETECTORS[name]
        found = find(g).select(F.lit(name).alias("policy"), F.lit(severity).alias("severity"), "repo_id", "violator", "detail")
        if name == "antipattern" and g.exhibits is not None:
            own = g.exhibits.groupBy("repo_id", F.col("fqn").alias("violator"), F.col("pattern").alias("detail")).agg(F.min("severity").alias("own"))
            found = found.join(own, ["repo_id", "violator", "detail"], "left").select("policy", F.coalesce("own", "severity").alias("severity"), "repo_id", "violator", "detail")
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)
