"""Containment of paths: which directory owns which file, by whole path parts.

A prefix test on strings makes a nested loop of every file with every owner. Here each file is exploded into its ancestor
directories and joined by equality; ``a/b`` doesn't own ``a/b2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Every leading path of a path, itself included, the shortest first. Null gives null."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def owners(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(repo_id, file_path, path): every directory of ``dirs`` (repo_id, path) that holds a file of ``files``."""
    exploded = files.select("repo_id", "file_path", F.explode(ancestors(F.col("file_path"))).alias("path"))
    return exploded.join(dirs.select("repo_id", "path").distinct(), ["repo_id", "path"]).select("repo_id", "file_path", "path")


def longest_owner(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(repo_id, file_path, path): the innermost directory of ``dirs`` that holds each file; files without one are left out."""
    held = owners(files.select("repo_id", "file_path").distinct(), dirs)
    return held.groupBy("repo_id", "file_path").agg(F.max_by("path", F.length("path")).alias("path"))


def tree(dirs: DataFrame) -> DataFrame:
    """(repo_id, path, parent, depth): each directory with the innermost other one around it, null at a root."""
    inner = dirs.select("repo_id", F.col("path").alias("file_path")).distinct()
    around = owners(inner, dirs).where("path <> file_path").groupBy("repo_id", "file_path").agg(F.max_by("path", F.length("path")).alias("parent"), F.count("*").alias("depth"))
    return inner.join(around, ["repo_id", "file_path"], "left").select("repo_id", F.col("file_path").alias("path"), "parent", F.coalesce("depth", F.lit(0)).alias("depth"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, tolerance_ms: int) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of its keys that is nearest in time, within a tolerance.

    Times fall into buckets of the tolerance's width; a row meets the buckets beside its own by equality. Of equally near rows
    the earlier one is taken. right's columns come prefixed with ``near_``. Rows without such a partner are left out.
    """
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(left_ms) / tolerance_ms) + d for d in (-1, 0, 1)])))
    b = right.select(*keys, *[F.col(c).alias(f"near_{c}") for c in right.columns if c not in keys], F.floor(F.col(right_ms) / tolerance_ms).alias("_b"))
    gap = F.abs(F.col(left_ms) - F.col(f"near_{right_ms}"))
    met = a.join(b, [*keys, "_b"]).withColumn("gap_ms", gap).where(F.col("gap_ms") <= tolerance_ms).drop("_b")
    w = Window.partitionBy(*left.columns).orderBy("gap_ms", f"near_{right_ms}")
    return met.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
