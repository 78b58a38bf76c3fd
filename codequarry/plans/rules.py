"""Queries of the rule scan, snapshots and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import graph
from codequarry.operators import policies
from codequarry.plans.code import _CTE, _IMPORTS, _cls, _fld, _mod, _mth, _src, imported
from codequarry.tables import read


def _graph(spark: SparkSession, d: str) -> policies.Graph:
    return policies.Graph(_cls(spark, d), _mth(spark, d), _fld(spark, d), imported(spark, d))


def policy_violations_union(spark: SparkSession, d: str) -> DataFrame:
    """Violators of all default rules."""
    return policies.scan(_graph(spark, d)).select("policy", "repo_id", "violator", "detail").distinct()


def policy_report(spark: SparkSession, d: str) -> DataFrame:
    """Number and first violators of each rule and repository."""
    return policies.report(policies.scan(_graph(spark, d)))


def unannotated_public(spark: SparkSession, d: str) -> DataFrame:
    """Public methods of one kind of class without an annotation."""
    return policies.violations(_graph(spark, d), policies.Rule("public_needs_annotation", "Repository", "Cacheable"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One row per class: counts, lines, and ordered lists cut to a budget of characters."""
    m = _mth(spark, d).select("repo_id", F.col("class_fqn").alias("fqn"), "name").distinct().groupBy("repo_id", "fqn").agg(F.sort_array(F.collect_set("name")).alias("ms"))
    f = _fld(spark, d).select("repo_id", F.col("class_fqn").alias("fqn"), "name").distinct().groupBy("repo_id", "fqn").agg(F.sort_array(F.collect_set("name")).alias("fs"))
    c = _cls(spark, d).groupBy("repo_id", "fqn").agg(F.coalesce(F.max(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0))), F.lit(0)).alias("loc"))
    none = F.array().cast("array<string>")
    got = c.join(m, ["repo_id", "fqn"], "left").join(f, ["repo_id", "fqn"], "left").select("repo_id", "fqn", "loc", F.coalesce("ms", none).alias("ms"), F.coalesce("fs", none).alias("fs"))
    keep = F.when(F.length(F.array_join("ms", ",")) > 400, F.slice("ms", 1, 10)).otherwise(F.slice("ms", 1, 60))
    return got.select("repo_id", "fqn", "loc", F.size("ms").cast("long").alias("n_methods"), F.size("fs").cast("long").alias("n_fields"), F.array_join(keep, ",").alias("methods"))


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each repository, zero where a kind has none."""
    counts = [(name, df.groupBy("repo_id").agg(F.count("*").alias(name))) for name, df in (("n_modules", _mod(spark, d)), ("n_classes", _cls(spark, d)), ("n_methods", _mth(spark, d)), ("n_scans", read(spark, d, "scan_log", "id", "repo_id").where("repo_id is not null").distinct()))]
    got = counts[0][1]
    for _, df in counts[1:]:
        got = got.join(df, "repo_id", "full_outer")
    return got.select("repo_id", *[F.coalesce(n, F.lit(0)).alias(n) for n, _ in counts])


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest of three feeds in one list."""
    from codequarry.functions.times import iso_ms

    scans = read(spark, d, "scan_log", "id", "started_at").distinct().select(F.lit("scan").alias("kind"), F.col("id").cast("string").alias("key"), iso_ms(F.col("started_at")).alias("ms")).distinct()
    turns = read(spark, d, "turns", "turn_id", "ts").distinct().select(F.lit("turn").alias("kind"), F.col("turn_id").alias("key"), iso_ms(F.col("ts")).alias("ms"))
    calls = read(spark, d, "llm_calls", "id", "ts").distinct().select(F.lit("call").alias("kind"), F.col("id").cast("string").alias("key"), iso_ms(F.col("ts")).alias("ms"))
    return scans.unionByName(turns).unionByName(calls).orderBy(F.desc("ms"), "kind", "key").limit(10)


def data_stores(spark: SparkSession, d: str) -> DataFrame:
    """Files that touch a data store, by the words that tell it."""
    signatures = {"cache": ("cache.", "Cacheable"), "store": ("store.find", "store.put"), "index": ("index.put", "index.set", "index.update"), "log": ("log.debug", "logging")}
    files = _src(spark, d, "repo_id", "file_path", "content").where("content is not null")
    hits = F.array_compact(F.array(*[F.when(F.expr(" or ".join(f"contains(content, '{w}')" for w in words)), F.lit(name)) for name, words in signatures.items()]))
    return files.select("repo_id", F.explode(hits).alias("store")).groupBy("repo_id", "store").agg(F.count("*").alias("n_files"))


def doc_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of each method's comment, tags and markers stripped."""
    doc = F.regexp_replace(F.regexp_replace("docstring", r"\{@\w+ ([^}]*)\}", "$1"), r"(?s)\s*@\w+.*$", "")
    first = F.trim(F.regexp_extract(doc, r"^(?s)(.*?[.!?])(?:\s|$)", 1))
    return _mth(spark, d).where("docstring is not null").select("repo_id", "fqn", first.alias("first")).where("first <> ''").distinct()


def short_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths relative to their repository, long ones by their last four parts."""
    inner = F.regexp_replace("file_path", r"^/(?:repos|workspace/src)/[^/]+/", "")
    parts = F.split(inner, "/")
    return _src(spark, d, "repo_id", "file_path").select("file_path", F.when(F.size(parts) > 4, F.array_join(F.slice(parts, -4, 4), "/")).otherwise(inner).alias("short"))


def logical_backup(spark: SparkSession, d: str) -> DataFrame:
    """Modules as statements that write them again, quotes doubled."""
    q = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    return _mod(spark, d).select("repo_id", "path", F.concat(F.lit("INSERT OR REPLACE INTO modules VALUES ("), F.concat_ws(", ", q("repo_id"), q("path"), q("name"), q("build_tool")), F.lit(");")).alias("statement"))


def threshold_findings(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose metrics pass a threshold, by a table of metrics, bands and limits."""
    c = read(spark, d, "llm_calls", "id", "source", "error", "elapsed_ms").distinct()
    m = c.groupBy("source").agg((F.count("error") * 100.0 / F.count("*")).alias("error_pct"), F.max("elapsed_ms").cast("double").alias("max_ms"))
    long = m.unpivot(["source"], ["error_pct", "max_ms"], "metric", "value")
    limits = spark.createDataFrame([("error_pct", "warn", 3.0), ("error_pct", "critical", 6.0), ("max_ms", "warn", 60000.0), ("max_ms", "critical", 600000.0)], "metric string, band string, least double")
    w = Window.partitionBy("source", "metric").orderBy(F.desc("least"))
    return long.join(F.broadcast(limits), "metric").where("value >= least").withColumn("k", F.row_number().over(w)).where("k = 1").select("source", "metric", "band")  # four rows


def package_prefix_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Classes below each two-part package prefix, with a separator, so that names that only begin alike stay apart."""
    prefix = F.array_join(F.slice(F.split("package_fqn", r"\."), 1, 2), ".")
    return _cls(spark, d).groupBy("repo_id", prefix.alias("prefix")).agg(F.countDistinct("package_fqn").alias("n_packages"), F.countDistinct("fqn").alias("n_classes"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Class names as component tags: camel case to kebab case."""
    kebab = F.lower(F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1-$2"))
    return _cls(spark, d).select("name", kebab.alias("tag")).distinct()


def having_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Repositories in which more than a twentieth of the methods are static."""
    static = F.count_if(F.array_contains("modifiers", "static"))
    return _mth(spark, d).groupBy("repo_id").agg(F.count("*").alias("n"), static.alias("n_static")).where("n_static * 20 > n")


QUERIES = {f.__name__: f for f in (policy_violations_union, policy_report, unannotated_public, snapshots, dashboard, recent_events, data_stores, doc_first_lines, short_paths, logical_backup, threshold_findings, package_prefix_siblings, name_variants, having_ratio)}

_V = """, per AS (SELECT c.repo_id, c.fqn, any_value(c.name) AS name, max(c.javadoc) AS javadoc, (SELECT count(*) FROM mth m WHERE m.repo_id = c.repo_id AND m.class_fqn = c.fqn) AS n FROM cls c GROUP BY c.repo_id, c.fqn),
v AS (SELECT 'many_methods' AS policy, 'warning' AS severity, repo_id, fqn AS violator, CAST(n AS VARCHAR) AS detail FROM per WHERE n > 30
UNION ALL SELECT 'long_class', 'warning', repo_id, fqn, CAST(end_line - start_line AS VARCHAR) FROM cls WHERE end_line - start_line > 300
UNION ALL SELECT 'large_package', 'warning', repo_id, package_fqn, CAST(count(DISTINCT fqn) AS VARCHAR) FROM cls GROUP BY repo_id, package_fqn HAVING count(DISTINCT fqn) > 50
UNION ALL SELECT 'untested_package', 'warning', repo_id, package_fqn, CAST(count(*) AS VARCHAR) FROM cls GROUP BY repo_id, package_fqn HAVING count(*) FILTER (NOT regexp_matches(name, 'Test|Spec')) >= 3 AND count(*) FILTER (regexp_matches(name, 'Test|Spec')) = 0
UNION ALL SELECT 'undocumented', 'warning', repo_id, fqn, CAST(n AS VARCHAR) FROM per WHERE n > 10 AND (repo_id, fqn) IN (SELECT (repo_id, fqn) FROM cls WHERE javadoc IS NULL)
UNION ALL SELECT 'undocumented_public', 'warning', repo_id, class_fqn, CAST(count(*) AS VARCHAR) FROM mth WHERE list_contains(modifiers, 'public') AND docstring IS NULL GROUP BY repo_id, class_fqn HAVING count(*) >= 3
UNION ALL SELECT 'duplicate', 'warning', repo_id, min(fqn), name FROM cls GROUP BY repo_id, name HAVING count(DISTINCT fqn) > 1
UNION ALL SELECT 'missing_sibling', 'warning', repo_id, fqn, regexp_replace(name, 'Reader$', 'Writer') FROM cls c WHERE name LIKE '%Reader' AND NOT EXISTS (SELECT 1 FROM cls o WHERE o.repo_id = c.repo_id AND o.name = regexp_replace(c.name, 'Reader$', 'Writer'))
UNION ALL SELECT 'no_import', 'error', i.repo_id, c.fqn, i.target FROM imp i JOIN cls c USING (repo_id, file_path) WHERE list_contains(string_split(i.target, '.'), 'store') AND list_contains(string_split(c.package_fqn, '.'), 'web')
UNION ALL SELECT 'deprecated_public', 'info', repo_id, fqn, 'deprecated' FROM mth WHERE len(list_filter(annotations, lambda a: contains(a, 'Deprecated'))) > 0 AND list_contains(modifiers, 'public')
UNION ALL SELECT 'long_method', 'info', repo_id, fqn, CAST(end_line - start_line AS VARCHAR) FROM mth WHERE end_line - start_line > 8
UNION ALL SELECT 'many_parameters', 'info', repo_id, fqn, CAST(len(parameters) AS VARCHAR) FROM mth WHERE len(parameters) > 2)"""
_HEAD = _CTE + ", " + _IMPORTS
_STORES = {"cache": ("cache.", "Cacheable"), "store": ("store.find", "store.put"), "index": ("index.put", "index.set", "index.update"), "log": ("log.debug", "logging")}
SQL = {
    "policy_violations_union": _HEAD + _V + " SELECT DISTINCT policy, repo_id, violator, detail FROM v",
    "policy_report": _HEAD + _V + " SELECT policy, severity, repo_id, count(*) AS n, array_to_string(list_sort(list(violator))[1:5], ',') AS samples FROM (SELECT DISTINCT policy, severity, repo_id, violator FROM v) GROUP BY ALL",
    "unannotated_public": _CTE + " SELECT DISTINCT repo_id, fqn AS violator, 'Cacheable' AS detail FROM mth WHERE list_contains(modifiers, 'public') AND class_fqn LIKE '%Repository' AND NOT coalesce(len(list_filter(annotations, lambda a: contains(a, 'Cacheable'))) > 0, false)",
    "snapshots": _CTE + """, m AS (SELECT repo_id, class_fqn AS fqn, list_sort(list(DISTINCT name)) AS ms FROM mth GROUP BY ALL), f AS (SELECT repo_id, class_fqn AS fqn, count(DISTINCT name) AS n FROM fld GROUP BY ALL),
        c AS (SELECT repo_id, fqn, max(greatest(end_line - start_line, 0)) AS loc FROM cls GROUP BY ALL) SELECT c.repo_id, c.fqn, CASE WHEN c.loc IS NULL THEN 0 ELSE c.loc END AS loc, coalesce(len(ms), 0) AS n_methods, coalesce(n, 0) AS n_fields,
        array_to_string(CASE WHEN length(array_to_string(coalesce(ms, []), ',')) > 400 THEN ms[1:10] ELSE coalesce(ms, [])[1:60] END, ',') AS methods FROM c LEFT JOIN m USING (repo_id, fqn) LEFT JOIN f USING (repo_id, fqn)""",
    "dashboard": _CTE + """ SELECT repo_id, CAST(sum(a) AS BIGINT) AS n_modules, CAST(sum(b) AS BIGINT) AS n_classes, CAST(sum(c) AS BIGINT) AS n_methods, CAST(sum(d) AS BIGINT) AS n_scans FROM (SELECT repo_id, 1 AS a, 0 AS b, 0 AS c, 0 AS d FROM mod
        UNION ALL SELECT repo_id, 0, 1, 0, 0 FROM cls UNION ALL SELECT repo_id, 0, 0, 1, 0 FROM mth UNION ALL SELECT repo_id, 0, 0, 0, 1 FROM (SELECT DISTINCT id, repo_id FROM scan_log WHERE repo_id IS NOT NULL)) GROUP BY repo_id""",
    "data_stores": _CTE + " SELECT repo_id, store, count(*) AS n_files FROM (" + " UNION ALL ".join(f"SELECT repo_id, '{s}' AS store FROM src WHERE content IS NOT NULL AND ({' OR '.join(f"contains(content, '{w}')" for w in words)})" for s, words in _STORES.items()) + ") GROUP BY ALL",
    "short_paths": _CTE + " SELECT DISTINCT file_path, CASE WHEN len(p) > 4 THEN array_to_string(p[-4:], '/') ELSE array_to_string(p, '/') END AS short FROM (SELECT repo_id, file_path, string_split(regexp_replace(file_path, '^/(?:repos|workspace/src)/[^/]+/', ''), '/') AS p FROM src)",
    "logical_backup": _CTE + " SELECT repo_id, path, 'INSERT OR REPLACE INTO modules VALUES (' || concat_ws(', ', " + ", ".join(f"coalesce('''' || replace({c}, '''', '''''') || '''', 'NULL')" for c in ("repo_id", "path", "name", "build_tool")) + ") || ');' AS statement FROM mod",
    "threshold_findings": "WITH m AS (SELECT source, count(error) * 100.0 / count(*) AS e, max(elapsed_ms) AS x FROM (SELECT DISTINCT id, source, error, elapsed_ms FROM llm_calls) GROUP BY source) SELECT source, 'error_pct' AS metric, CASE WHEN e >= 6 THEN 'critical' ELSE 'warn' END AS band FROM m WHERE e >= 3 UNION ALL SELECT source, 'max_ms', CASE WHEN x >= 600000 THEN 'critical' ELSE 'warn' END FROM m WHERE x >= 60000",
    "package_prefix_siblings": _CTE + " SELECT repo_id, array_to_string(string_split(package_fqn, '.')[1:2], '.') AS prefix, count(DISTINCT package_fqn) AS n_packages, count(DISTINCT fqn) AS n_classes FROM cls GROUP BY ALL",
    "name_variants": _CTE + " SELECT DISTINCT name, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS tag FROM cls",
    "having_ratio": _CTE + " SELECT repo_id, count(*) AS n, count(*) FILTER (list_contains(modifiers, 'static')) AS n_static FROM mth GROUP BY repo_id HAVING n_static * 20 > count(*)",
    "doc_first_lines": _CTE + " SELECT DISTINCT repo_id, fqn, trim(regexp_extract(regexp_replace(regexp_replace(docstring, '\\{@\\w+ ([^}]*)\\}', '\\1', 'g'), '(?s)\\s*@\\w+.*$', ''), '(?s)^(.*?[.!?])(?:\\s|$)', 1)) AS \"first\" FROM mth WHERE docstring IS NOT NULL AND trim(regexp_extract(regexp_replace(regexp_replace(docstring, '\\{@\\w+ ([^}]*)\\}', '\\1', 'g'), '(?s)\\s*@\\w+.*$', ''), '(?s)^(.*?[.!?])(?:\\s|$)', 1)) <> ''",
    "recent_events": "WITH e AS (SELECT DISTINCT 'scan' AS kind, CAST(id AS VARCHAR) AS key, started_at AS ts FROM scan_log UNION ALL SELECT DISTINCT 'turn', turn_id, ts FROM turns UNION ALL SELECT DISTINCT 'call', CAST(id AS VARCHAR), ts FROM llm_calls), m AS (SELECT kind, key, CAST(epoch_ms(CAST(CASE WHEN regexp_matches(ts, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ)) AS BIGINT) AS ms FROM e) SELECT * FROM m ORDER BY ms DESC, kind, key LIMIT 10",
}
