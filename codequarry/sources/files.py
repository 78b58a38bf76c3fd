"""Reading of source trees, transcripts and registries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that hold no source of the project, and the languages of file suffixes.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "target", "build", "dist", "out", "__pycache__", ".venv", "venv", ".gradle", ".idea", ".tox")
LANGUAGES = {"java": "java", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp", "cls": "apex", "trigger": "apex", "abap": "abap", "html": "markup", "cmp": "markup", "app": "markup", "xml": "xml"}


def suffix(path: Column) -> Column:
    """The last suffix of a path in lower case, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language that a path's suffix tells, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.nullif(suffix(path), F.lit("")))


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(LANGUAGES), skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, length, modified, content) of the files below ``root`` with one of the suffixes, outside skipped directories.

    Each path comes once. Content that is no UTF-8 is decoded with replacement signs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit(""))
    wanted = files.where(suffix(F.col("path")).isin(*suffixes) & ~F.arrays_overlap(F.split(inside, "/"), F.array(*map(F.lit, skipped))))
    return wanted.select("path", "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content")).dropDuplicates(["path"])


TRANSCRIPT = "timestamp string, sessionId string, type string, message struct<role:string, content:variant, usage:struct<input_tokens:long, output_tokens:long, cache_read_input_tokens:long, cache_creation_input_tokens:long>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, record) of JSON-lines transcripts; blank lines are skipped, and a file with an unreadable line is void."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value")).where("trim(value) <> ''")
    parsed = lines.withColumn("record", F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE"}))
    void = lines.where(F.try_parse_json("value").isNull()).select("file").distinct()
    return parsed.join(void, "file", "left_anti").select("file", "line_no", "record")


def near_in_time(files: DataFrame, at: Column, hours: float = 2.0) -> DataFrame:
    """Files modified within some hours of an instant."""
    return files.where(F.abs(F.unix_seconds("modified") - F.unix_seconds(at)) <= hours * 3600)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, path) of a JSON registry {repo_id: path}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("repo_id", "path"))


def catalog(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, data_type) of what the session knows."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
