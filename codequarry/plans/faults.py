"""Queries of the detectors over the derived code graph, with SQL written from what each detector is to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import detectors, policies, scoring
from codequarry.plans import model

#: Bounds lowered so that every detector has cases in the derived graph.
LIMITS = {"large_package": 8, "includes": 2, "module_methods": 20}


def _graph(spark, d):
    g = model.graph(spark, d)
    g.exhibits = scoring.god_classes(g.cls, g.mth, g.fld, 30, 3).select("repo_id", "fqn", F.lit("god_class").alias("pattern"), F.lit("error").alias("severity"))
    g.limits = LIMITS
    return g


def detected(spark: SparkSession, d: str) -> DataFrame:
    """The violators of all 23 detectors."""
    return detectors.scan(_graph(spark, d))


def detected_report(spark: SparkSession, d: str) -> DataFrame:
    """Each detector's count and first five violators by repository."""
    return policies.report(detectors.scan(_graph(spark, d)))


def god_class_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Classes with more than 30 methods and more than three fields, both counted apart."""
    g = model.graph(spark, d)
    return scoring.god_classes(g.cls, g.mth, g.fld, 30, 3)


CATALOGUE = {
    "service": {"name_suffix": ("Service", "Manager")}, "controller": {"name_suffix": ("Controller",), "annotation_contains": ("Service",), "language": "java"}, "handler": {"name_suffix": ("Handler",), "method_name_contains": ("handle",)}, "inheritor": {"base_class_contains": ("Config", "Factory"), "language": "script"},
    "written_config": {"generated_path": ("/core/",), "name_suffix": ("Config", "Dto")}, "red": {"name_prefix": ("Red",)}, "god_class": {"method_count_gt": 30, "field_count_gt": 3},
}


def patterns_by_signals(spark: SparkSession, d: str) -> DataFrame:
    """Classes of each pattern of a catalogue with signals of every kind; a repository's language is r0's java, the others' script."""
    cls = model.classes(spark, d)
    languages = cls.select("repo_id").distinct().withColumn("language", F.when(F.col("repo_id") == "r0", "java").otherwise("script"))
    return scoring.detected_patterns(cls, model.methods(spark, d), model.fields(spark, d), model.edges(spark, d), languages, CATALOGUE)


QUERIES = {f.__name__: f for f in (detected, detected_report, god_class_pattern, patterns_by_signals)}

_NT = "NOT contains({0}, 'Test') AND NOT contains({0}, 'test')"
_NATIVE = "kind IN ('class', 'struct', 'template_class')"
_DEP = "len(list_filter(coalesce({0}.annotations, []), lambda a: contains(a, 'Deprecated'))) > 0"
_SCRIPT = "regexp_matches(file_path, '\\.(js|ts|jsx|tsx|mjs|cjs)$')"
_GOD = "SELECT c.repo_id, c.fqn, m.n AS n_methods, f.n AS n_fields FROM cls c JOIN (SELECT class_fqn, count(*) AS n FROM mth GROUP BY 1) m ON m.class_fqn = c.fqn JOIN (SELECT class_fqn, count(DISTINCT name) AS n FROM fld GROUP BY 1) f ON f.class_fqn = c.fqn WHERE NOT contains(c.fqn, '$') AND m.n > {0} AND f.n > {1}"
_IMP = "(SELECT DISTINCT e.repo_id, a.fqn AS source, b.fqn AS target, a.package_fqn AS pa, b.package_fqn AS pb, a.file_path AS fa, b.file_path AS fb, a.kind AS ka, b.kind AS kb FROM edge e JOIN cls a ON a.fqn = e.source JOIN cls b ON b.fqn = e.target WHERE type = 'IMPORTS')"
#: One SELECT of (repo_id, violator, detail) for each detector.
FIND = {
    "antipattern": ("error", f"SELECT repo_id, fqn, 'god_class' FROM ({_GOD.format(30, 3)})"),
    "circular-deps": ("error", f"SELECT DISTINCT x.repo_id, x.pa, x.pb FROM {_IMP} x JOIN {_IMP} y ON x.repo_id = y.repo_id AND x.pa = y.pb AND x.pb = y.pa WHERE x.pa < x.pb"),
    "deep-inheritance": ("warning", "SELECT repo_id, source, '' FROM up GROUP BY ALL HAVING max(depth) >= 6"),
    "untested-packages": ("warning", f"SELECT repo_id, package_fqn, CAST(count(*) FILTER ({_NT.format('fqn')}) AS VARCHAR) FROM cls WHERE NOT contains(package_fqn, 'test') GROUP BY repo_id, package_fqn HAVING count(*) FILTER ({_NT.format('fqn')}) >= 3 AND count(*) FILTER (contains(fqn, 'Test') OR name LIKE '%Test' OR name LIKE '%Tests') = 0"),
    "large-packages": ("warning", "SELECT repo_id, package_fqn, CAST(count(*) AS VARCHAR) FROM cls GROUP BY repo_id, package_fqn HAVING count(*) > 8"),
    "service-no-interface": ("warning", "SELECT repo_id, fqn, '' FROM cls WHERE name LIKE '%Service' AND NOT contains(fqn, 'Test') AND fqn NOT IN (SELECT source FROM edge WHERE type = 'IMPLEMENTS')"),
    "deprecated-with-callers": ("warning", f"SELECT d.repo_id, d.fqn, CAST(count(*) AS VARCHAR) FROM cls d JOIN {_IMP} i ON i.target = d.fqn JOIN cls u ON u.fqn = i.source WHERE {_DEP.format('d')} AND NOT ({_DEP.format('u')}) AND NOT contains(u.fqn, 'Test') GROUP BY d.repo_id, d.fqn"),
    "undocumented-high-blast": ("warning", f"SELECT c.repo_id, c.fqn, CAST(size AS VARCHAR) FROM cls c JOIN size s ON s.fqn = c.fqn WHERE size >= 5 AND javadoc IS NULL AND kind <> 'module' AND {_NT.format('c.fqn')}"),
    "undocumented-module": ("warning", "SELECT repo_id, fqn, '' FROM cls WHERE kind = 'module' AND javadoc IS NULL"),
    "undocumented-core-method": ("warning", f"SELECT DISTINCT c.repo_id, c.fqn || '#' || m.name, '' FROM cls c JOIN size s ON s.fqn = c.fqn JOIN mth m ON m.class_fqn = c.fqn WHERE size >= 3 AND docstring IS NULL AND NOT starts_with(m.name, '_') AND kind <> 'module' AND {_NT.format('c.fqn')}"),
    "layer-import": ("error", f"SELECT repo_id, source, target FROM {_IMP} WHERE contains(fa, '/console/') AND contains(fb, '/ingestion/')"),
    "driver-import": ("error", f"SELECT repo_id, fqn, '' FROM cls WHERE contains(file_path, '/mcp/') AND (contains(fqn, 'neo4j') OR contains(javadoc, 'neo4j') OR contains(javadoc, 'GraphDatabase') OR contains(javadoc, 'bolt://')) UNION SELECT repo_id, source, '' FROM {_IMP} WHERE contains(fa, '/mcp/') AND (contains(target, 'neo4j') OR contains(fb, 'neo4j'))"),
    "duplicate-class-names": ("warning", f"SELECT repo_id, min(fqn), CAST(count(DISTINCT fqn) AS VARCHAR) FROM cls WHERE {_NT.format('fqn')} AND kind <> 'module' AND name NOT IN ('Config', 'Settings', 'Meta', 'Router', 'main', 'app', 'log', 'logger', 'client', 'handler') GROUP BY repo_id, name HAVING count(DISTINCT fqn) > 1"),
    "missing-virtual-destructor": ("error", f"SELECT repo_id, fqn, '' FROM cls c WHERE {_NATIVE} AND NOT contains(fqn, 'Test') AND fqn IN (SELECT class_fqn FROM mth WHERE list_contains(modifiers, 'virtual')) AND fqn NOT IN (SELECT class_fqn FROM mth WHERE list_contains(modifiers, 'virtual') AND list_contains(modifiers, 'destructor'))"),
    "raw-pointer": ("warning", f"SELECT repo_id, fqn, '' FROM cls WHERE {_NATIVE} AND NOT contains(fqn, 'Test') AND fqn IN (SELECT class_fqn FROM mth WHERE list_contains(modifiers, 'destructor')) AND fqn IN (SELECT class_fqn FROM fld WHERE type_name LIKE '%*' OR contains(type_name, '* '))"),
    "include-chains": ("warning", f"SELECT repo_id, source, CAST(count(*) AS VARCHAR) FROM {_IMP} WHERE ka IN ('class', 'struct', 'module', 'template_class') GROUP BY repo_id, source HAVING count(*) > 2"),
    "trigger-no-handler": ("warning", "SELECT repo_id, fqn, '' FROM cls t WHERE kind = 'trigger' AND NOT EXISTS (SELECT 1 FROM cls h WHERE h.repo_id = t.repo_id AND h.name LIKE '%Handler' AND (h.name = t.name || 'Handler' OR h.name = t.name || 'TriggerHandler' OR starts_with(t.name, split_part(h.name, 'Handler', 1))))"),
    "soql-risk": ("warning", "SELECT DISTINCT repo_id, fqn, '' FROM mth WHERE fqn IN (SELECT source FROM asked)"),
    "missing-sharing": ("warning", "SELECT repo_id, fqn, '' FROM cls WHERE kind IN ('class', 'abstract_class') AND file_path LIKE '%.cls' AND NOT list_has_any(modifiers, ['with sharing', 'without sharing', 'inherited sharing']) AND NOT contains(fqn, 'Test')"),
    "async-no-error-handling": ("warning", "SELECT repo_id, fqn, '' FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM (SELECT DISTINCT repo_id, fqn FROM mth WHERE list_contains(modifiers, 'async') AND fqn NOT IN (SELECT caller FROM call WHERE lower(split_part(callee, '#', 2)) IN ('catch', 'reject', 'handleerror', 'onerror')))) WHERE n >= 3"),
    "class-missing-jsdoc": ("info", f"SELECT repo_id, fqn, '' FROM cls WHERE {_SCRIPT} AND kind IN ('class', 'module') AND coalesce(javadoc, '') = '' AND name NOT LIKE '%Test' AND name NOT LIKE '%Spec'"),
    "large-module": ("warning", f"SELECT c.repo_id, c.fqn, CAST(count(*) AS VARCHAR) FROM cls c JOIN mth m ON m.class_fqn = c.fqn WHERE {_SCRIPT.replace('file_path', 'c.file_path')} AND kind = 'module' GROUP BY c.repo_id, c.fqn HAVING count(*) > 20"),
    "circular-imports": ("error", f"SELECT x.repo_id, x.source, x.target FROM {_IMP} x JOIN {_IMP} y ON x.source = y.target AND x.target = y.source WHERE x.source < x.target AND x.ka = 'module' AND x.kb = 'module'"),
}
_BLAST = """, back(node, dep) AS (SELECT DISTINCT target, source FROM edge WHERE source <> target UNION SELECT b.node, e.source FROM back b JOIN edge e ON e.target = b.dep WHERE e.source <> b.node),
size AS (SELECT node AS fqn, least(count(*), 500) AS size FROM back GROUP BY node)"""
_UP = ", up(repo_id, source, at_, depth) AS (SELECT repo_id, source, target, 1 FROM edge WHERE type = 'EXTENDS' UNION ALL SELECT u.repo_id, u.source, e.target, u.depth + 1 FROM up u JOIN edge e ON e.source = u.at_ AND e.type = 'EXTENDS')"
_FOUND = model.CTE + _BLAST + _UP + ", found(policy, severity, repo_id, violator, detail) AS (" + " UNION ALL ".join(f"SELECT '{k}', '{s}', * FROM ({q})" for k, (s, q) in FIND.items()) + ")"
SQL = {
    "detected": _FOUND + " SELECT * FROM found",
    "detected_report": _FOUND + " SELECT policy, severity, repo_id, count(DISTINCT violator) AS n, array_to_string(list_sort(list(DISTINCT violator))[1:5], ',') AS samples FROM found GROUP BY policy, severity, repo_id",
    "god_class_pattern": model.CTE + " " + _GOD.format(30, 3),
}
_BASES = "fqn IN (SELECT source FROM edge WHERE type <> 'IMPORTS' AND (contains(split_part(target, '.', -1), 'Config') OR contains(split_part(target, '.', -1), 'Factory')))"
_SIGNAL = (
    ("service", "name_suffix", "name LIKE '%Service' OR name LIKE '%Manager'"), ("controller", "name_suffix", "repo_id = 'r0' AND name LIKE '%Controller'"), ("controller", "annotation_contains", "repo_id = 'r0' AND len(list_filter(coalesce(annotations, []), lambda a: contains(a, 'Service'))) > 0"), ("handler", "name_suffix", "name LIKE '%Handler'"),
    ("handler", "method_name_contains", "fqn IN (SELECT class_fqn FROM mth WHERE contains(name, 'handle'))"), ("inheritor", "base_class_contains", f"repo_id <> 'r0' AND {_BASES}"), ("written_config", "generated_path", "contains(file_path, '/core/') AND (name LIKE '%Config' OR name LIKE '%Dto')"), ("red", "name_prefix", "starts_with(name, 'Red')"),
    ("god_class", "counts", "fqn IN (SELECT class_fqn FROM mth GROUP BY 1 HAVING count(*) > 30) AND fqn IN (SELECT class_fqn FROM fld GROUP BY 1 HAVING count(DISTINCT name) > 3)"),
)
SQL["patterns_by_signals"] = model.CTE + ", h AS (" + " UNION ALL ".join(f"SELECT repo_id, '{p}' AS pattern_id, fqn, '{s}' AS s FROM cls WHERE {t}" for p, s, t in _SIGNAL) + ") SELECT repo_id, pattern_id, fqn, array_to_string(list_sort(list(DISTINCT s)), ',') AS signals FROM h GROUP BY ALL"
