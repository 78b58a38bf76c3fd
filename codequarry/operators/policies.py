"""Architectural rules as data: a rule is a small tree that compiles to a plan over the graph tables.

Rules never are text that is run. ``violations`` builds one DataFrame for a rule, and ``scan`` unions those of many, each with the
same columns, so that one aggregation reports all. Sentences are compiled in ``wording``, faults of the graph found in ``detectors``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry import graph


@dataclass(frozen=True)
class Rule:
    """kind: one of ``BUILDERS``; subject and object: what the phrasing names; limit: a threshold where the kind has one."""

    kind: str
    subject: str = ""
    object: str = ""
    limit: int = 0
    severity: str = "warning"


@dataclass
class Graph:
    """The tables that rules read: cls, mth, fld, and imports (repo_id, file_path, target)."""

    cls: DataFrame
    mth: DataFrame
    fld: DataFrame
    imports: DataFrame


def _classes(df: DataFrame, detail) -> DataFrame:
    return df.select("repo_id", F.col("fqn").alias("violator"), detail.cast("string").alias("detail"))


def _per_class(g: Graph) -> DataFrame:
    n = g.mth.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n"))
    return g.cls.select("repo_id", "fqn", "name", "file_path", "package_fqn", "javadoc").distinct().join(n, ["repo_id", "fqn"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _many_methods(g: Graph, r: Rule) -> DataFrame:
    return _classes(_per_class(g).where(F.col("n") > r.limit), F.col("n"))


def _long_class(g: Graph, r: Rule) -> DataFrame:
    loc = F.col("end_line") - F.col("start_line")
    return _classes(g.cls.where(loc > r.limit), loc)


def _large_package(g: Graph, r: Rule) -> DataFrame:
    got = g.cls.groupBy("repo_id", "package_fqn").agg(F.countDistinct("fqn").alias("n")).where(F.col("n") > r.limit)
    return got.select("repo_id", F.col("package_fqn").alias("violator"), F.col("n").cast("string").alias("detail"))


def _untested_package(g: Graph, r: Rule) -> DataFrame:
    test = F.col("name").rlike("Test|Spec")
    got = g.cls.groupBy("repo_id", "package_fqn").agg(F.count_if(~test).alias("n"), F.count_if(test).alias("t")).where((F.col("n") >= r.limit) & (F.col("t") == 0))
    return got.select("repo_id", F.col("package_fqn").alias("violator"), F.col("n").cast("string").alias("detail"))


def _undocumented(g: Graph, r: Rule) -> DataFrame:
    return _classes(_per_class(g).where((F.col("n") > r.limit) & F.col("javadoc").isNull()), F.col("n"))


def _undocumented_public(g: Graph, r: Rule) -> DataFrame:
    m = g.mth.where(F.array_contains("modifiers", "public") & F.col("docstring").isNull()).groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n"))
    return _classes(m.where(F.col("n") >= r.limit), F.col("n"))


def _duplicate(g: Graph, r: Rule) -> DataFrame:
    got = g.cls.groupBy("repo_id", "name").agg(F.countDistinct("fqn").alias("n"), F.min("fqn").alias("fqn")).where("n > 1")
    return _classes(got, F.col("name"))


def _missing_sibling(g: Graph, r: Rule) -> DataFrame:
    names = g.cls.select("repo_id", F.col("name").alias("wanted")).distinct()
    own = g.cls.where(F.col("name").endswith(r.subject)).withColumn("wanted", F.regexp_replace("name", f"{re.escape(r.subject)}$", r.object))
    return _classes(own.join(names, ["repo_id", "wanted"], "left_anti"), F.regexp_replace("name", f"{re.escape(r.subject)}$", r.object)).distinct()


def _no_import(g: Graph, r: Rule) -> DataFrame:
    """Files of one package part that import another."""
    part = lambda c, p: F.arrays_overlap(F.split(c, r"[./]"), F.array(*map(F.lit, [p])))
    bad = g.imports.where(part(F.col("target"), r.object)).join(g.cls.where(part(F.col("package_fqn"), r.subject)).select("repo_id", "file_path", "fqn"), ["repo_id", "file_path"])
    return _classes(bad, F.col("target")).distinct()


def _needs_annotation(g: Graph, r: Rule) -> DataFrame:
    own = g.cls.where(F.col("name").endswith(r.subject))
    return _classes(own.where(~F.coalesce(F.exists("annotations", lambda a: a.contains(r.object)), F.lit(False))), F.lit(r.object)).distinct()


def _public_needs_annotation(g: Graph, r: Rule) -> DataFrame:
    m = g.mth.where(F.array_contains("modifiers", "public") & graph.simple_name(F.col("class_fqn")).endswith(r.subject))
    bad = m.where(~F.coalesce(F.exists("annotations", lambda a: a.contains(r.object)), F.lit(False)))
    return bad.select("repo_id", F.col("fqn").alias("violator"), F.lit(r.object).alias("detail")).distinct()


def _deprecated_static(g: Graph, r: Rule) -> DataFrame:
    m = g.mth.where(F.exists("annotations", lambda a: a.contains("Deprecated")) & F.array_contains("modifiers", "public"))
    return m.select("repo_id", F.col("fqn").alias("violator"), F.lit("deprecated").alias("detail")).distinct()


def _long_method(g: Graph, r: Rule) -> DataFrame:
    loc = F.col("end_line") - F.col("start_line")
    return g.mth.where(loc > r.limit).select("repo_id", F.col("fqn").alias("violator"), loc.cast("string").alias("detail")).distinct()


def _many_parameters(g: Graph, r: Rule) -> DataFrame:
    return g.mth.where(F.array_size("parameters") > r.limit).select("repo_id", F.col("fqn").alias("violator"), F.array_size("parameters").cast("string").alias("detail")).distinct()


BUILDERS: dict[str, Callable[[Graph, Rule], DataFrame]] = {
    "many_methods": _many_methods, "long_class": _long_class, "large_package": _large_package, "untested_package": _untested_package, "undocumented": _undocumented, "undocumented_public": _undocumented_public, "duplicate": _duplicate, "missing_sibling": _missing_sibling, "no_import": _no_import,
    "needs_annotation": _needs_annotation, "public_needs_annotation": _public_needs_annotation, "deprecated_public": _deprecated_static, "long_method": _long_method, "many_parameters": _many_parameters,
}
#: Rules that are scanned by default.
DEFAULT = (
    Rule("many_methods", limit=30), Rule("long_class", limit=300), Rule("large_package", limit=50), Rule("untested_package", limit=3), Rule("undocumented", limit=10), Rule("undocumented_public", limit=3), Rule("duplicate"), Rule("missing_sibling", "Reader", "Writer"),
    Rule("no_import", "web", "store", severity="error"), Rule("deprecated_public", severity="info"), Rule("long_method", limit=8, severity="info"), Rule("many_parameters", limit=2, severity="info"),
)
SEVERITY = {"error": 0, "warning": 1, "info": 2}


def violations(g: Graph, rule: Rule) -> DataFrame:
    """(repo_id, violator, detail) of one rule."""
    return BUILDERS[rule.kind](g, rule)


def scan(g: Graph, rules: tuple[Rule, ...] = DEFAULT) -> DataFrame:
    """(policy, severity, repo_id, violator, detail) of all rules."""
    return reduce(DataFrame.unionByName, [violations(g, r).select(F.lit(r.kind).alias("policy"), F.lit(r.severity).alias("severity"), "repo_id", "violator", "detail") for r in rules])


def report(found: DataFrame, sample: int = 5) -> DataFrame:
    """(policy, severity, repo_id, n, samples): the number of violators and the first of them by name, at most ``sample``.

    The samples are kept by a ranking before they are collected, so that a rule with many violators makes no long list.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("policy", "repo_id").orderBy("violator")
    ranked = found.select("policy", "severity", "repo_id", "violator").distinct().withColumn("k", F.row_number().over(w))
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= sample, F.struct("k", "violator")))), lambda x: x["violator"]), ",")
    return ranked.groupBy("policy", "severity", "repo_id").agg(F.count("*").alias("n"), first.alias("samples"))
