"""Node and edge tables of a code base, and how edges are found from names.

Every table keeps repo_id as the tenant's key; names are looked up within it. A class, method or field that came several times
counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that calls share everywhere; edges by name alone would tie unrelated methods together.
STOP_NAMES = ("get", "set", "of", "build", "toString", "equals", "hashCode", "main")


def package_of(fqn: Column) -> Column:
    """All but the last dotted part; '' without a dot."""
    return F.when(F.instr(fqn, ".") > 0, F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def simple_name(fqn: Column) -> Column:
    """The last dotted part."""
    return F.substring_index(fqn, ".", -1)


def _fqn(symbol: Column) -> Column:
    return F.replace(F.split_part(symbol, F.lit("#"), F.lit(1)), F.lit("/"), F.lit("."))


def classes(symbols: DataFrame) -> DataFrame:
    """repo_id, fqn, name, package_fqn, file_path, start_line, end_line, annotations, modifiers, javadoc of each class."""
    own = symbols.where("kind = 'class'").dropDuplicates(["symbol_id"])
    fqn = _fqn(F.col("symbol"))
    doc = F.nullif(F.trim(F.array_join(F.coalesce("documentation", F.array()), "\n")), F.lit(""))
    return own.select("repo_id", fqn.alias("fqn"), F.col("display_name").alias("name"), package_of(fqn).alias("package_fqn"), "file_path", "start_line", "end_line", "annotations", "modifiers", doc.alias("javadoc"))


def methods(symbols: DataFrame) -> DataFrame:
    """repo_id, fqn (class#name), name, class_fqn, modifiers, parameters, return_type, lines and docstring of each method."""
    own = symbols.where("kind = 'method'").dropDuplicates(["symbol_id"])
    cls = _fqn(F.col("symbol"))
    doc = F.nullif(F.trim(F.array_join(F.coalesce("documentation", F.array()), "\n")), F.lit(""))
    return own.select("repo_id", F.concat(cls, F.lit("#"), "display_name").alias("fqn"), F.col("display_name").alias("name"), cls.alias("class_fqn"), "modifiers", "parameters", "annotations", "return_type", "start_line", "end_line", doc.alias("docstring"))


def fields(symbols: DataFrame) -> DataFrame:
    """repo_id, fqn, name, class_fqn, type_name of each field."""
    own = symbols.where("kind = 'field'").dropDuplicates(["symbol_id"])
    cls = _fqn(F.col("symbol"))
    return own.select("repo_id", F.concat(cls, F.lit("#"), "display_name").alias("fqn"), F.col("display_name").alias("name"), cls.alias("class_fqn"), "type_name", "modifiers")


def resolve_unique(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo_id, source, target): unresolved names that one class of the tenant bears.

    raw: repo_id, source, name; targets: repo_id, name, fqn. A name that several classes bear resolves to none here; see
    ``resolve_imported``.
    """
    once = targets.groupBy("repo_id", "name").agg(F.countDistinct("fqn").alias("n"), F.min("fqn").alias("target")).where("n = 1")
    return raw.dropDuplicates(["repo_id", "source", "name"]).join(once, ["repo_id", "name"]).where("source <> target").select("repo_id", "source", "target")


def resolve_as_coded(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``resolve_unique``, but an ambiguous name links to every class that bears it."""
    return raw.dropDuplicates(["repo_id", "source", "name"]).join(targets.select("repo_id", "name", F.col("fqn").alias("target")).distinct(), ["repo_id", "name"]).where("source <> target").select("repo_id", "source", "target").distinct()


def resolve_imported(raw: DataFrame, targets: DataFrame, imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """Second pass: sources without an edge yet take those classes of the name that they import."""
    left = raw.join(resolved.select("repo_id", "source").distinct(), ["repo_id", "source"], "left_anti")
    named = left.join(targets.select("repo_id", "name", F.col("fqn").alias("target")).distinct(), ["repo_id", "name"])
    return named.join(imports.select("repo_id", "source", "target").distinct(), ["repo_id", "source", "target"], "left_semi").select("repo_id", "source", "target").distinct()


def class_edges(facts: DataFrame, cls: DataFrame, kinds: tuple[str, ...] = ("IMPORTS", "EXTENDS", "IMPLEMENTS")) -> DataFrame:
    """(repo_id, source, target): edges of ``facts`` between two classes of one tenant, each once, none to itself.

    An import without an owner is every class's of its file. Dotted names are whole ones; others are looked up as by
    ``resolve_unique`` and, where several classes bear them, by the source's imports. What the tenant has no class for is left out.
    """
    own = cls.select("repo_id", "fqn", "name", "file_path").distinct()
    found = facts.where(F.col("kind") == "edge").where(F.col("name").isin(*kinds)).select("repo_id", F.col("path").alias("file_path"), "owner", F.col("target").alias("named"))
    raw = found.join(own, ["repo_id", "file_path"]).where("coalesce(owner, '') = '' or owner = name").select("repo_id", F.col("fqn").alias("source"), "named").distinct()
    targets = own.select("repo_id", "name", "fqn")
    whole = raw.where("contains(named, '.')").join(own.select("repo_id", F.col("fqn").alias("named")).distinct(), ["repo_id", "named"]).select("repo_id", "source", F.col("named").alias("target"))
    short = raw.where("not contains(named, '.')").withColumnRenamed("named", "name")
    once = resolve_unique(short, targets)
    open_ = short.join(targets.groupBy("repo_id", "name").agg(F.countDistinct("fqn").alias("n")).where("n > 1").select("repo_id", "name"), ["repo_id", "name"], "left_semi")
    several = resolve_imported(open_, targets, whole, once.limit(0))
    return whole.unionByName(once).unionByName(several).where("source <> target").distinct()


def calls_same_class(raw: DataFrame, mth: DataFrame) -> DataFrame:
    """(repo_id, caller, callee): calls by name to another method of the caller's class. raw: repo_id, caller, class_fqn, name."""
    own = mth.select("repo_id", "class_fqn", "name", F.col("fqn").alias("callee"))
    return raw.join(own, ["repo_id", "class_fqn", "name"]).where("caller <> callee").select("repo_id", "caller", "callee").distinct()


def calls_same_package(raw: DataFrame, mth: DataFrame, resolved: DataFrame) -> DataFrame:
    """Second pass: callers without an edge, names outside the stop list, one such method in the package.

    Where the tables have no package_fqn the package is that of the class's name.
    """
    packaged = lambda df: df if "package_fqn" in df.columns else df.withColumn("package_fqn", package_of(F.col("class_fqn")))
    own = packaged(mth).select("repo_id", "package_fqn", "name", F.col("fqn").alias("callee")).where(~F.col("name").isin(*STOP_NAMES))
    once = own.groupBy("repo_id", "package_fqn", "name").agg(F.countDistinct("callee").alias("n"), F.min("callee").alias("callee")).where("n = 1")
    left = packaged(raw.join(resolved.select("repo_id", "caller").distinct(), ["repo_id", "caller"], "left_anti"))
    return left.join(once, ["repo_id", "package_fqn", "name"]).where("caller <> callee").select("repo_id", "caller", "callee").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables by key, the row with the greatest ``order`` winning, a new row before an old one on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, each once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes outside the files of ``paths`` (repo_id, file_path), and the edges (source, target) between them."""
    gone = nodes.join(paths, ["repo_id", "file_path"], "left_semi").select("repo_id", "fqn").distinct()
    kept = nodes.join(paths, ["repo_id", "file_path"], "left_anti")
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("fqn", end), ["repo_id", end], "left_anti")
    return kept, edges


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """``old`` without the scopes that ``new`` has, and ``new``."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new, allowMissingColumns=True)
