"""Queries that assemble what is known of a class, a module or a question, and rules of a repository's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.operators.scoring import role
from codequarry.plans import faults, model
from codequarry.plans.activity import _CTE
from codequarry.plans.code import imported
from codequarry.tables import read

#: Most entries of each list of a class's model, and characters of the whole before lists are cut further.
METHODS, IMPORTS, DEPENDENTS, TESTS, BUDGET = 60, 20, 10, 5, 900


def _first(column: str, most: int):
    return F.slice(F.sort_array(F.coalesce(column, F.array().cast("array<string>"))), 1, most)


def object_models(spark: SparkSession, d: str) -> DataFrame:
    """The model of each class: methods, imports, dependents and tests as ordered lists, counts, and whether other modules import it.

    Lists have a most of their own; where the whole is longer than the budget, methods are cut to 20, and if that isn't enough,
    imports to ten.
    """
    cls = model.classes(spark, d).select("repo_id", "fqn", "name", "module")
    m = model.methods(spark, d).groupBy(F.col("class_fqn").alias("fqn")).agg(F.collect_set("name").alias("ms"), F.count_if(F.array_contains("modifiers", "public")).alias("n_public"))
    e = model.edges(spark, d).where("type = 'IMPORTS'")
    names = cls.select("fqn", "name", "module")
    out = e.join(names.withColumnRenamed("fqn", "target"), "target").groupBy(F.col("source").alias("fqn")).agg(F.collect_set("name").alias("im"))
    back = e.join(names.select(F.col("fqn").alias("source"), F.col("name").alias("by"), F.col("module").alias("other")), "source").join(cls.select(F.col("fqn").alias("target"), "module"), "target")
    back = back.groupBy(F.col("target").alias("fqn")).agg(F.collect_set("by").alias("de"), F.countDistinct("source").alias("n_dependents"), F.bool_or(F.col("other") != F.col("module")).alias("is_module_api"))
    got = cls.join(m, "fqn", "left").join(out, "fqn", "left").join(back, "fqn", "left")
    got = got.select("repo_id", "fqn", _first("ms", METHODS).alias("ms"), _first("im", IMPORTS).alias("im"), _first("de", DEPENDENTS).alias("de"), F.coalesce("n_public", F.lit(0)).alias("n_public"), F.coalesce("n_dependents", F.lit(0)).alias("n_dependents"), F.coalesce("is_module_api", F.lit(False)).alias("is_module_api"))
    text = lambda ms, im: F.length(F.concat_ws(",", ms, im, "de"))
    short = F.when(text("ms", "im") > BUDGET, F.slice("ms", 1, 20)).otherwise(F.col("ms"))
    got = got.withColumn("short", short)
    return got.select("repo_id", "fqn", F.array_join("short", ",").alias("methods"), F.array_join(F.when(text("short", "im") > BUDGET, F.slice("im", 1, 10)).otherwise(F.col("im")), ",").alias("imports"), F.array_join("de", ",").alias("dependents"), "n_public", "n_dependents", "is_module_api")


SEVERITIES = {"god_class": (True, "error"), "written_config": (True, "warning"), "red": (True, "info")}


def patterns_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of a repository in the order of a report: bad ones first, then by severity, then by number of matches."""
    n = faults.patterns_by_signals(spark, d).groupBy("repo_id", "pattern_id").agg(F.count("*").alias("n"))
    bad = F.col("pattern_id").isin(*SEVERITIES)
    severity = reduce(lambda a, k: a.when(F.col("pattern_id") == k, SEVERITIES[k][1]), SEVERITIES, F.when(F.lit(False), "")).otherwise("info")
    rank = F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)
    w = Window.partitionBy("repo_id").orderBy((~bad).cast("int"), rank, F.desc("n"), "pattern_id")
    return n.select("repo_id", "pattern_id", bad.alias("bad"), severity.alias("severity"), "n", F.row_number().over(w).alias("place"))


def module_details(spark: SparkSession, d: str) -> DataFrame:
    """Each module with its classes, imports into and out of it, and its three most imported classes."""
    cls = model.classes(spark, d).select("repo_id", "fqn", "module")
    e = model.edges(spark, d).where("type = 'IMPORTS'").join(cls.select(F.col("fqn").alias("source"), F.col("module").alias("a")), "source").join(cls.select(F.col("fqn").alias("target"), F.col("module").alias("b")), "target")
    across = e.where("a <> b")
    into, out = across.groupBy("repo_id", F.col("b").alias("module")).agg(F.count("*").alias("n_in")), across.groupBy("repo_id", F.col("a").alias("module")).agg(F.count("*").alias("n_out"))
    w = Window.partitionBy("repo_id", "module").orderBy(F.desc("n"), "target")
    top = e.groupBy("repo_id", F.col("b").alias("module"), "target").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w)).where("k <= 3")
    top = top.groupBy("repo_id", "module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "target"))), lambda x: x["target"]), ",").alias("top"))
    got = cls.groupBy("repo_id", "module").agg(F.count("*").alias("n_classes"))
    for other in (into, out, top):
        got = got.join(other, ["repo_id", "module"], "left")
    return got.select("repo_id", "module", "n_classes", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("top", F.lit("")).alias("top"))


def own_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a repository's own: classes of more than 500 lines, modules without a test, audited classes without an interface."""
    cls = model.classes(spark, d)
    roles = cls.withColumn("role", role(F.col("name"), F.col("file_path"), F.col("annotations"), F.lit("class"), F.lit(True)))
    out = lambda df, rule, violator: df.select(F.lit(rule).alias("rule"), "repo_id", F.col(violator).alias("violator")).distinct()
    long = roles.where((F.col("end_line") - F.col("start_line") > 500) & (F.col("kind") != "module") & ~F.col("role").isin("TEST", "GENERATED"))
    tested = roles.where("role = 'TEST'").select("repo_id", "module")
    untested = cls.select("repo_id", "module").distinct().join(tested, ["repo_id", "module"], "left_anti")
    bare = cls.where(F.array_contains("annotations", "Audited")).join(model.edges(spark, d).where("type = 'IMPLEMENTS'").select(F.col("source").alias("fqn")), "fqn", "left_anti")
    return out(long, "long class", "fqn").unionByName(out(untested, "untested module", "module")).unionByName(out(bare, "no interface", "fqn"))


def question_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each class that a prompt names: its importers, their repositories, siblings in its folder, and the tokens that reading
    its file and theirs would take."""
    t = read(spark, d, "turns", "turn_id", "user_prompt").where("user_prompt is not null").distinct()
    asked = t.select("turn_id", F.explode(F.array_distinct(F.regexp_extract_all("user_prompt", F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1)))).alias("name"))
    cls = read(spark, d, "symbols", "repo_id", "display_name", "kind", "file_path").where("kind = 'class'").select("repo_id", F.col("display_name").alias("name"), "file_path").distinct()
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*/[^/]*$", 1)
    placed = cls.withColumn("folder", folder)
    siblings = placed.groupBy("repo_id", "folder").agg(F.count("*").alias("n_siblings"))
    sizes = read(spark, d, "source_files", "repo_id", "file_path", "content").select("repo_id", "file_path", F.coalesce(F.length("content"), F.lit(0)).alias("chars")).distinct()
    own = placed.join(siblings, ["repo_id", "folder"]).join(sizes, ["repo_id", "file_path"], "left").groupBy("name").agg(F.count("*").alias("n_classes"), F.max("n_siblings").alias("n_siblings"), F.sum(F.coalesce("chars", F.lit(0))).alias("own_chars"))
    users = imported(spark, d, True).select("repo_id", "file_path", F.col("target").alias("name")).distinct().join(sizes, ["repo_id", "file_path"]).groupBy("name").agg(F.count("*").alias("n_importers"), F.countDistinct("repo_id").alias("n_repos"), F.sum("chars").alias("chars"))
    got = asked.join(own, "name").join(users, "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return got.select("turn_id", "name", "n_classes", "n_siblings", zero("n_importers").alias("n_importers"), zero("n_repos").alias("n_repos"), F.floor((F.col("own_chars") + zero("chars")) / 4).alias("tokens"))


QUERIES = {f.__name__: f for f in (object_models, patterns_ordered, module_details, own_rules, question_evidence)}

_IM = "(SELECT DISTINCT e.repo_id, e.source, e.target, a.name AS an, a.module AS am, b.name AS bn, b.module AS bm FROM edge e JOIN cls a ON a.fqn = e.source JOIN cls b ON b.fqn = e.target WHERE type = 'IMPORTS')"
SQL = {
    "object_models": model.CTE + f""", im AS {_IM}, a AS (SELECT c.repo_id, c.fqn, coalesce((SELECT list_sort(list(DISTINCT name))[1:60] FROM mth m WHERE m.class_fqn = c.fqn), []) AS ms, coalesce((SELECT list_sort(list(DISTINCT bn))[1:20] FROM im WHERE source = c.fqn), []) AS im, coalesce((SELECT list_sort(list(DISTINCT an))[1:10] FROM im WHERE target = c.fqn), []) AS de,
        (SELECT count(*) FILTER (list_contains(modifiers, 'public')) FROM mth m WHERE m.class_fqn = c.fqn) AS n_public, (SELECT count(DISTINCT source) FROM im WHERE target = c.fqn) AS n_dependents, coalesce((SELECT bool_or(am <> bm) FROM im WHERE target = c.fqn), false) AS is_module_api FROM cls c),
        b AS (SELECT *, CASE WHEN length(array_to_string(list_concat(ms, im, de), ',')) > 900 THEN ms[1:20] ELSE ms END AS sh FROM a) SELECT repo_id, fqn, array_to_string(sh, ',') AS methods, array_to_string(CASE WHEN length(array_to_string(list_concat(sh, im, de), ',')) > 900 THEN im[1:10] ELSE im END, ',') AS imports, array_to_string(de, ',') AS dependents, n_public, n_dependents, is_module_api FROM b""",
    "patterns_ordered": faults.SQL["patterns_by_signals"].replace(" SELECT repo_id, pattern_id, fqn, array_to_string(list_sort(list(DISTINCT s)), ',') AS signals FROM h GROUP BY ALL", ", n AS (SELECT repo_id, pattern_id, count(DISTINCT fqn) AS n FROM h GROUP BY ALL), v AS (SELECT *, pattern_id IN ('god_class', 'written_config', 'red') AS bad, CASE pattern_id WHEN 'god_class' THEN 'error' WHEN 'written_config' THEN 'warning' ELSE 'info' END AS severity FROM n) SELECT repo_id, pattern_id, bad, severity, n, row_number() OVER (PARTITION BY repo_id ORDER BY bad DESC, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, n DESC, pattern_id) AS place FROM v"),
    "module_details": model.CTE + f", im AS {_IM}, tp AS (SELECT repo_id, bm AS module, target, row_number() OVER (PARTITION BY repo_id, bm ORDER BY n DESC, target) AS k FROM (SELECT repo_id, bm, target, count(*) AS n FROM im GROUP BY repo_id, bm, target)) SELECT c.repo_id, c.module, n_classes, (SELECT count(*) FROM im WHERE im.repo_id = c.repo_id AND bm = c.module AND am <> bm) AS n_in, (SELECT count(*) FROM im WHERE im.repo_id = c.repo_id AND am = c.module AND am <> bm) AS n_out, coalesce((SELECT array_to_string(list(target ORDER BY k), ',') FROM tp WHERE tp.repo_id = c.repo_id AND tp.module = c.module AND k <= 3), '') AS top FROM (SELECT repo_id, module, count(*) AS n_classes FROM cls GROUP BY ALL) c",
    "own_rules": model.CTE + ", v AS (SELECT 'long class' AS rule, repo_id, fqn AS violator FROM cls WHERE end_line - 1 > 500 AND kind <> 'module' AND NOT regexp_matches(name, '(Test|Tests|IT|TestCase|Spec)$') UNION SELECT 'untested module', repo_id, module FROM cls GROUP BY repo_id, module HAVING count(*) FILTER (regexp_matches(name, '(Test|Tests|IT|TestCase|Spec)$')) = 0 UNION SELECT 'no interface', repo_id, fqn FROM cls WHERE list_contains(annotations, 'Audited') AND fqn NOT IN (SELECT source FROM edge WHERE type = 'IMPLEMENTS')) SELECT * FROM v",
    "question_evidence": _CTE + """, q AS (SELECT DISTINCT turn_id, unnest(regexp_extract_all(user_prompt, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS name FROM turns WHERE user_prompt IS NOT NULL), k AS (SELECT DISTINCT repo_id, display_name AS name, file_path, regexp_extract(file_path, '^(.*)/[^/]*/[^/]*$', 1) AS folder FROM symbols WHERE kind = 'class'),
        z AS (SELECT DISTINCT repo_id, file_path, coalesce(length(content), 0) AS chars FROM source_files), o AS (SELECT name, count(*) AS n_classes, max(n) AS n_siblings, sum(coalesce(chars, 0)) AS own_chars FROM (SELECT *, count(*) OVER (PARTITION BY repo_id, folder) AS n FROM k) LEFT JOIN z USING (repo_id, file_path) GROUP BY name),
        u AS (SELECT name, count(*) AS n_importers, count(DISTINCT repo_id) AS n_repos, sum(chars) AS chars FROM (SELECT DISTINCT repo_id, file_path, unnest(regexp_extract_all(content, '(?:import [\\w.]*\\.|import \\{ |from \\w+ import )([A-Z]\\w*)', 1)) AS name FROM source_files WHERE content IS NOT NULL) JOIN z USING (repo_id, file_path) GROUP BY name)
        SELECT turn_id, name, n_classes, n_siblings, coalesce(n_importers, 0) AS n_importers, coalesce(n_repos, 0) AS n_repos, CAST(floor((own_chars + coalesce(chars, 0)) / 4.0) AS BIGINT) AS tokens FROM q JOIN o USING (name) LEFT JOIN u USING (name)""",
}
