"""Queries over the facts that the readers find in source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources import facts as facts_
from codequarry.sources import layout
from codequarry.tables import read


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each file once: repeated rows, equal in all columns, are dropped by their key."""
    files = read(spark, d, "source_files", "repo_id", F.col("file_path").alias("path"), "content").dropDuplicates(["repo_id", "path"])
    return facts_.facts(files)


def parsed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes that the readers find in source files."""
    return _facts(spark, d).where("kind = 'class' and name <> '<module>'").select("repo_id", F.col("path").alias("file_path"), "name").distinct()


def parsed_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods of classes that the readers find in source files."""
    return _facts(spark, d).where("kind = 'method' and owner <> '<module>'").select("repo_id", F.col("path").alias("file_path"), "name").distinct()


def parsed_fields(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).where("kind = 'field' and path like '%.java'").select("repo_id", F.col("path").alias("file_path"), "name").distinct()


def parsed_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports of Java files by package."""
    f = _facts(spark, d).where("kind = 'edge' and name = 'IMPORTS' and path like '%.java' and target not like '%*'")
    return f.groupBy(F.regexp_replace("target", r"\.[^.]*$", "").alias("package_fqn")).agg(F.count("*").alias("n"))


def fact_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("kind", F.when(F.col("kind") == "edge", F.col("name")).otherwise("").alias("edge")).agg(F.count("*").alias("n"))


def modules_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Modules by the layout of the tree alone."""
    return layout.modules(read(spark, d, "source_files", "repo_id", F.col("file_path").alias("path")))


def tech_stack(spark: SparkSession, d: str) -> DataFrame:
    """Techniques by the words of sources."""
    return layout.techniques(read(spark, d, "source_files", "repo_id", "file_path", "content").dropDuplicates(["repo_id", "file_path"]))


def build_systems(spark: SparkSession, d: str) -> DataFrame:
    """The build system of each repository by marker files, the modules' tools standing for them; unknown without any."""
    marker = F.element_at(F.create_map(*[F.lit(x) for tool, name in (("gradle", "build.gradle"), ("maven", "pom.xml"), ("npm", "package.json"), ("cmake", "CMakeLists.txt"), ("python", "pyproject.toml"), ("poetry", "pyproject.toml"), ("sfdx", "sfdx-project.json")) for x in (tool, name)]), F.col("build_tool"))
    m = read(spark, d, "modules", "repo_id", "path", "build_tool").where("path is not null").distinct()
    return facts_.build_system(m.select("repo_id", F.concat_ws("/", "path", F.coalesce(marker, F.lit("README"))).alias("path")))


QUERIES = {f.__name__: f for f in (parsed_classes, parsed_methods, parsed_fields, parsed_imports, fact_kinds, modules_discovered, tech_stack, build_systems)}
_SYM = "SELECT DISTINCT s.repo_id, s.file_path, s.display_name AS name FROM symbols s JOIN (SELECT DISTINCT repo_id, file_path FROM source_files WHERE content IS NOT NULL) f USING (repo_id, file_path) WHERE kind = '{0}'"
#: The symbols of the same files, those of minified code (one letter) aside.
SQL = {
    "parsed_classes": _SYM.format("class"),
    "parsed_methods": _SYM.format("method") + " AND length(s.display_name) > 1",
    "parsed_fields": _SYM.format("field") + " AND s.file_path LIKE '%.java'",
    "parsed_imports": "SELECT regexp_replace(t, '\\.[^.]*$', '') AS package_fqn, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '(?m)^import ([\\w.]*\\w);', 1)) AS t FROM (SELECT DISTINCT repo_id, file_path, content FROM source_files) WHERE file_path LIKE '%.java' AND content IS NOT NULL) GROUP BY ALL",
}
_MARK = "CASE build_tool WHEN 'gradle' THEN 2 WHEN 'maven' THEN 4 WHEN 'sfdx' THEN 5 WHEN 'cmake' THEN 6 WHEN 'npm' THEN 7 WHEN 'python' THEN 8 WHEN 'poetry' THEN 8 END"
SQL |= {
    "modules_discovered": "SELECT DISTINCT repo_id, regexp_extract(file_path, '^(.*/(?:services|apps|modules|plugins|packages)/[^/]+)/', 1) AS path, 'services' AS stage FROM source_files WHERE regexp_matches(file_path, '^(.*/(?:services|apps|modules|plugins|packages)/[^/]+)/')",
    "tech_stack": "SELECT repo_id, technique, count(DISTINCT file_path) AS n_files FROM source_files f JOIN (VALUES " + ", ".join(f"('{k}', '{w}')" for k, words in layout.TECHNIQUES.items() for w in words) + ") t(technique, word) ON contains(f.content, t.word) GROUP BY ALL",
    "build_systems": f"SELECT repo_id, coalesce(CASE min({_MARK}) WHEN 2 THEN 'gradle' WHEN 4 THEN 'maven' WHEN 5 THEN 'sfdx' WHEN 6 THEN 'cmake' WHEN 7 THEN 'npm' WHEN 8 THEN 'python' END, 'unknown') AS build_tool FROM modules WHERE path IS NOT NULL GROUP BY repo_id",
}
