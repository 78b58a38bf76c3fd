"""How a source tree is laid out: its modules, routes and techniques, from paths and contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marker files of modules by the stage in which they are looked for, and folders that services lie in.
STAGES = (
    ("gradle", ("settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts")), ("maven", ("pom.xml",)), ("build file", ("BUILD", "BUILD.bazel", "meson.build")), ("sfdx", ("sfdx-project.json",)), ("cmake", ("CMakeLists.txt",)), ("npm", ("package.json",)), ("python", ("__init__.py",)),
)
SERVICE_FOLDERS = ("services", "apps", "modules", "plugins", "packages")


def modules(files: DataFrame) -> DataFrame:
    """(repo_id, path, stage): the modules of each repository by the first stage that finds any.

    files: repo_id, path. A marker's folder is a module; of Python packages only those not inside another. A repository without
    markers has the folders below those of services. Repeated rows count once, null paths not at all.
    """
    own = files.select("repo_id", "path").where("path is not null").distinct()
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    found = [own.where(name.isin(*marks)).select("repo_id", folder.alias("path"), F.lit(k).alias("k"), F.lit(stage).alias("stage")) for k, (stage, marks) in enumerate(STAGES)]
    inner = found[-1].select("repo_id", F.col("path").alias("parent")).distinct()
    found[-1] = found[-1].withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(inner, ["repo_id", "parent"], "left_anti").select("repo_id", "path", "k", "stage")
    service = F.regexp_extract("path", rf"^(.*/(?:{'|'.join(SERVICE_FOLDERS)})/[^/]+)/", 1)
    found.append(own.select("repo_id", service.alias("path"), F.lit(len(STAGES)).alias("k"), F.lit("services").alias("stage")).where("path <> ''"))
    every = reduce(DataFrame.unionByName, found).distinct()
    first = every.groupBy("repo_id").agg(F.min("k").alias("k"))
    return every.join(first, ["repo_id", "k"], "left_semi").select("repo_id", "path", "stage")


def routes(files: DataFrame) -> DataFrame:
    """(path, method, url, function, parameters, template): routes that decorators declare, in order of their place.

    files: path, content. The text is cut before each decorator, so that a route's own function and template are looked for in its
    piece alone. Null contents have none.
    """
    pieces = files.where("content is not null").select("path", F.posexplode(F.split("content", r"(?m)(?=^@\w+\.(?:get|post|put|patch|delete|route)\()")).alias("at", "piece"))
    got = lambda pattern, group=1: F.regexp_extract("piece", pattern, group)
    url = got(r"^@\w+\.\w+\(\s*[\"']([^\"']*)")
    out = pieces.select("path", "at", F.upper(got(r"^@\w+\.(\w+)\(")).alias("method"), url.alias("url"), got(r"def\s+(\w+)\s*\(").alias("function"), F.regexp_extract_all(url, F.lit(r"[{<](?:\w+:)?(\w+)(?::[^}>]*)?[}>]"), F.lit(1)).alias("parameters"), got(r"[\"']([\w/.\-]+\.html)[\"']").alias("template"))
    return out.where("method <> ''").withColumn("method", F.when(F.col("method") == "ROUTE", "GET").otherwise(F.col("method"))).drop("at")


# Words of sources that tell a technique.
TECHNIQUES = {"logging": ("import logging", "log.debug(", "console.log("), "collections": ("java.util", "collections"), "events": ("emit(", "addEventListener"), "storage": ("store.find(", "Store store"), "web": ("fetch(", "http"), "typed python": ("-> str", "dict[str")}


def techniques(files: DataFrame, table: dict[str, tuple[str, ...]] = TECHNIQUES) -> DataFrame:
    """(repo_id, technique, n_files): files of each repository that a technique's words stand in. files: repo_id, content."""
    hits = [F.when(reduce(lambda a, b: a | b, (F.col("content").contains(w) for w in words)), F.lit(name)) for name, words in table.items()]
    return files.where("content is not null").select("repo_id", F.explode(F.array_compact(F.array(*hits))).alias("technique")).groupBy("repo_id", "technique").agg(F.count("*").alias("n_files"))
