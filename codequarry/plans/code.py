"""Queries over classes, methods, fields, modules and files of the code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import graph
from codequarry.operators import paths, scoring
from codequarry.tables import cut, read

_CTE = """WITH cls AS (SELECT DISTINCT ON (symbol_id) repo_id, replace(split_part(symbol, '#', 1), '/', '.') AS fqn, display_name AS name,
    file_path, start_line, end_line, annotations, modifiers, nullif(trim(array_to_string(documentation, chr(10))), '') AS javadoc,
    regexp_replace(replace(split_part(symbol, '#', 1), '/', '.'), '\\.[^.]*$', '') AS package_fqn FROM symbols WHERE kind = 'class'),
mth AS (SELECT DISTINCT ON (symbol_id) repo_id, replace(split_part(symbol, '#', 1), '/', '.') AS class_fqn, display_name AS name,
    replace(split_part(symbol, '#', 1), '/', '.') || '#' || display_name AS fqn, parameters, modifiers, return_type, start_line, end_line, annotations,
    nullif(trim(array_to_string(documentation, chr(10))), '') AS docstring FROM symbols WHERE kind = 'method'),
fld AS (SELECT DISTINCT ON (symbol_id) repo_id, replace(split_part(symbol, '#', 1), '/', '.') AS class_fqn, display_name AS name, type_name FROM symbols WHERE kind = 'field'),
mod AS (SELECT DISTINCT repo_id, module_id, name, path, build_tool FROM modules WHERE path IS NOT NULL),
src AS (SELECT DISTINCT repo_id, file_path, language, content FROM source_files)
"""


def _cls(spark, d):
    return graph.classes(read(spark, d, "symbols"))


def _mth(spark, d):
    return graph.methods(read(spark, d, "symbols"))


def _fld(spark, d):
    return graph.fields(read(spark, d, "symbols"))


def _mod(spark, d):
    return read(spark, d, "modules", "repo_id", "module_id", "name", "path", "build_tool").where("path is not null").distinct()


def _src(spark, d, *columns):
    return read(spark, d, "source_files", *(columns or ("repo_id", "file_path", "language", "content"))).distinct()


def imported(spark: SparkSession, d: str, simple: bool = False) -> DataFrame:
    """(repo_id, file_path, target): the imports of each file, each place a row; with ``simple`` the last names of imports of any language.

    The texts end here: what repeated rows are told apart by, and what is shuffled for it, are the names.
    """
    pattern = r"(?:import [\w.]*\.|import \{ |from \w+ import )([A-Z]\w*)" if simple else r"import ([a-z][\w.]*\.[A-Z]\w*);"
    found = read(spark, d, "source_files", "repo_id", "file_path", "content").where("content is not null").select("repo_id", "file_path", F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("targets"))
    return found.where(F.size("targets") > 0).distinct().select("repo_id", "file_path", F.explode("targets").alias("target"))


def types_per_package(spark: SparkSession, d: str) -> DataFrame:
    return _cls(spark, d).groupBy("repo_id", "package_fqn").agg(F.count("*").alias("n_types"))


def distinct_packages(spark: SparkSession, d: str) -> DataFrame:
    return _cls(spark, d).select("repo_id", "package_fqn", graph.simple_name(F.col("package_fqn")).alias("name")).distinct()


def packages_over_threshold(spark: SparkSession, d: str) -> DataFrame:
    return types_per_package(spark, d).where("n_types > 3")


def large_package_untested(spark: SparkSession, d: str) -> DataFrame:
    tested = F.count_if(F.col("name").rlike("(Test|Tests|IT|TestCase|Spec)$"))
    return _cls(spark, d).groupBy("repo_id", "package_fqn").agg(F.count("*").alias("n_types"), tested.alias("n_tests")).where("n_types >= 3 and n_tests = 0")


def file_loc_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Lines of code: the last line of each file, then their sum by repository."""
    ends = read(spark, d, "symbols", "repo_id", "file_path", "end_line").where("end_line is not null").groupBy("repo_id", "file_path").agg(F.max("end_line").alias("last"))
    return ends.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("last").alias("loc"))


def methods_per_class(spark: SparkSession, d: str) -> DataFrame:
    """Methods of every class, those without any among them."""
    own = _mth(spark, d).groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n"))
    return _cls(spark, d).select("repo_id", "fqn").distinct().join(own, ["repo_id", "fqn"], "left").select("repo_id", "fqn", F.coalesce("n", F.lit(0)).alias("n_methods"))


def god_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes with more than 30 methods and any field: classes of these tables have one field at most."""
    return scoring.god_classes(_cls(spark, d).where(~F.col("fqn").contains("Test")), _mth(spark, d), _fld(spark, d), 30, 0)


def classes_without_methods(spark: SparkSession, d: str) -> DataFrame:
    return _cls(spark, d).select("repo_id", "fqn").distinct().join(_mth(spark, d).select("repo_id", F.col("class_fqn").alias("fqn")), ["repo_id", "fqn"], "left_anti")


def classes_with_static_methods(spark: SparkSession, d: str) -> DataFrame:
    static = _mth(spark, d).where(F.array_contains("modifiers", "static")).select("repo_id", F.col("class_fqn").alias("fqn"))
    return _cls(spark, d).select("repo_id", "fqn", "name").distinct().join(static, ["repo_id", "fqn"], "left_semi")


def annotated_members(spark: SparkSession, d: str) -> DataFrame:
    """Methods with an annotation that contains a word, whatever array holds it."""
    return _mth(spark, d).where(F.exists("annotations", lambda a: a.contains("Cache") | a.contains("Transactional"))).select("repo_id", "fqn", F.size("annotations").cast("long").alias("n_annotations"))


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Classes that share their simple name with others of their repository: each with the first of them and their number."""
    c = _cls(spark, d).select("repo_id", "name", "fqn").distinct()
    groups = c.groupBy("repo_id", "name").agg(F.min("fqn").alias("first"), F.count("*").alias("n")).where("n > 1")
    return c.join(groups, ["repo_id", "name"]).select("repo_id", "name", "fqn", "first", "n")


def overloads(spark: SparkSession, d: str) -> DataFrame:
    return _mth(spark, d).groupBy("repo_id", "fqn").agg(F.count("*").alias("n")).where("n > 1")


def public_undocumented(spark: SparkSession, d: str) -> DataFrame:
    m = _mth(spark, d).where(F.array_contains("modifiers", "public") & F.col("docstring").isNull())
    return m.groupBy("repo_id", "class_fqn").agg(F.count("*").alias("n")).where("n >= 3")


def module_class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files below each module by whole path parts; nested modules each count, empty ones have 0."""
    held = paths.owners(_src(spark, d, "repo_id", "file_path"), _mod(spark, d)).groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    return _mod(spark, d).select("repo_id", "path").distinct().join(held, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("n", F.lit(0)).alias("n_files"))


def longest_prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    """The innermost module of every file."""
    return paths.longest_owner(_src(spark, d, "repo_id", "file_path"), _mod(spark, d))


def module_tree(spark: SparkSession, d: str) -> DataFrame:
    return paths.tree(_mod(spark, d).select("repo_id", "path"))


def module_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and greatest number of methods per class by innermost module, classes without methods counting as 0."""
    m = _mth(spark, d).groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n"))
    c = _cls(spark, d).select("repo_id", "fqn", "file_path").distinct().join(m, ["repo_id", "fqn"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    owner = longest_prefix_owner(spark, d)
    return c.join(owner, ["repo_id", "file_path"]).groupBy("repo_id", "path").agg(F.count("*").alias("n_classes"), F.round(F.avg("n"), 3).alias("avg_methods"), F.max("n").alias("max_methods"))


def module_dependency_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Edges between groups of classes: from_group, to_group, n; the 40 strongest, inner edges left out.

    A class depends on the package that an import of its file names; groups are the last parts of packages.
    """
    imports = imported(spark, d)
    own = _cls(spark, d).select("repo_id", "file_path", "package_fqn").distinct()
    edges = imports.join(own, ["repo_id", "file_path"]).select(graph.simple_name(F.col("package_fqn")).alias("from_group"), graph.simple_name(graph.package_of(F.col("target"))).alias("to_group"))
    return edges.where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_group", "to_group").limit(40)


def import_fan(spark: SparkSession, d: str) -> DataFrame:
    """Fan-out of files and fan-in of imported packages, from one distinct scan of imports."""
    imports = imported(spark, d).select("file_path", "target").distinct()
    package = imports.select("file_path", graph.package_of(F.col("target")).alias("package_fqn"))
    return package.groupBy("package_fqn").agg(F.count("*").alias("n_imports"), F.countDistinct("file_path").alias("fan_in"))


def external_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Imported names that no class of the repository bears: they become stub nodes, each once."""
    targets = imported(spark, d).select("repo_id", F.col("target").alias("fqn")).distinct()
    return targets.join(_cls(spark, d).select("repo_id", "fqn"), ["repo_id", "fqn"], "left_anti").select("repo_id", "fqn", graph.simple_name(F.col("fqn")).alias("name"), graph.package_of(F.col("fqn")).alias("package_fqn"))


def _raw_names(spark, d):
    names = imported(spark, d, True).withColumnRenamed("target", "name")
    own = _cls(spark, d).select("repo_id", "file_path", F.col("fqn").alias("source")).distinct()
    return names.join(own, ["repo_id", "file_path"]).select("repo_id", "source", "name").distinct()


def resolve_names_unique(spark: SparkSession, d: str) -> DataFrame:
    """Imported simple names that exactly one class of the repository bears."""
    return graph.resolve_unique(_raw_names(spark, d), _cls(spark, d).select("repo_id", "name", "fqn"))


def resolve_names_as_coded(spark: SparkSession, d: str) -> DataFrame:
    """The same, ambiguous names linking to every candidate."""
    return graph.resolve_as_coded(_raw_names(spark, d), _cls(spark, d).select("repo_id", "name", "fqn"))


def return_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Methods by the type that they return, generics stripped."""
    m = _mth(spark, d).select("repo_id", "fqn", "return_type").where("return_type is not null")
    return m.groupBy(F.trim(F.split_part("return_type", F.lit("<"), F.lit(1))).alias("type_base")).agg(F.count("*").alias("n_methods"))


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_role(_cls(spark, d), _fld(spark, d)).groupBy("role").agg(F.count("*").alias("n"))


def role_classify(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_role(_cls(spark, d), _fld(spark, d)).select("repo_id", "fqn", "role").distinct()


def _whole(spark, d):
    from codequarry.sources.facts import facts

    cls = _cls(spark, d)
    found = cut(facts(_src(spark, d, "repo_id", F.col("file_path").alias("path"), "content")).where("kind = 'edge' and name <> 'CALLS'"))  # parsed once
    edges = cut(graph.class_edges(found, cls))  # read by every round of the closure
    return scoring.whole_scores(scoring.enriched(cls, _mth(spark, d), _fld(spark, d), edges))


def hygiene_class(spark: SparkSession, d: str) -> DataFrame:
    """Role, coupling, blast size, warnings, the scores of all four dimensions, grade, tier, reasons and benefit of each class."""
    return _whole(spark, d)


def hygiene_repo(spark: SparkSession, d: str) -> DataFrame:
    """Scores of repositories of all four dimensions, tests and generated classes left out of the mean."""
    return scoring.whole_repo_scores(_whole(spark, d))


def hygiene_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by repository and grade, by repository, and over all, in one pass."""
    return _whole(spark, d).groupingSets([["repo_id", "grade"], ["repo_id"], []], "repo_id", "grade").agg(F.count("*").alias("n"))


def tier_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Classes of each repository by tier, one column for each."""
    tiers = ["god", "large", "medium", "small", "tiny"]
    return _whole(spark, d).groupBy("repo_id").agg(*[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in tiers])


def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    """Classes of each design pattern by the signals of a catalogue, with the signals that hit."""
    return scoring.patterns(_cls(spark, d))


def pattern_top_packages(spark: SparkSession, d: str) -> DataFrame:
    """The five packages with most matches of each pattern."""
    hits = pattern_matches(spark, d).groupBy("pattern_id", graph.package_of(F.col("fqn")).alias("package_fqn")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("pattern_id").orderBy(F.desc("n"), "package_fqn")
    return hits.withColumn("k", F.row_number().over(w)).where("k <= 5")


def missing_variant(spark: SparkSession, d: str) -> DataFrame:
    """Readers without a writer of the same stem in their repository."""
    c = _cls(spark, d).select("repo_id", "name").distinct()
    readers = c.where(F.col("name").endswith("Reader")).withColumn("missing", F.regexp_replace("name", "Reader$", "Writer"))
    return readers.join(c.select("repo_id", F.col("name").alias("missing")), ["repo_id", "missing"], "left_anti").select("repo_id", "name", "missing")


def classes_with_namesake_stem(spark: SparkSession, d: str) -> DataFrame:
    """Classes whose name holds another's whole name, found by the suffix that is stripped and not by a nested loop."""
    c = _cls(spark, d).select("repo_id", "name").distinct()
    stripped = c.withColumn("base", F.regexp_replace("name", "(Adapter|Builder|Client|Handler|Helper|Job|Service|Reader|Writer|Test)$", "")).where("base <> name and base <> ''")
    return stripped.join(c.withColumnRenamed("name", "base"), ["repo_id", "base"], "left_semi").select("repo_id", "base", "name")


def field_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Field types with generics stripped, most frequent first."""
    f = _fld(spark, d).where("type_name is not null")
    return f.groupBy(F.trim(F.split_part("type_name", F.lit("<"), F.lit(1))).alias("type_base")).agg(F.count("*").alias("n"), F.countDistinct("class_fqn").alias("n_classes"))


def class_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 classes by name, a total order making it the same each time."""
    return _cls(spark, d).select("repo_id", "fqn", "name").distinct().orderBy("name", "fqn", "repo_id").offset(50).limit(50)


def subsystem_histogram(spark: SparkSession, d: str) -> DataFrame:
    part = F.array_join(F.slice(F.split("fqn", r"\."), 1, 3), ".")
    return _cls(spark, d).groupBy(part.alias("subsystem")).agg(F.count("*").alias("n"))


def class_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive search that must match a whole name; the user's text is quoted."""
    return _cls(spark, d).where(F.col("name").rlike("^(?i).*\\Qpolicy\\E.*$")).select("repo_id", "fqn", "name").distinct()


def language_by_repo(spark: SparkSession, d: str) -> DataFrame:
    """The language with most files; of equals the first by rank."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.when(ext == "java", 1).when(ext == "py", 2).when(ext == "js", 3).when(ext == "ts", 4).otherwise(9)
    n = _src(spark, d, "repo_id", "file_path").select("repo_id", ext.alias("ext"), rank.alias("rank")).groupBy("repo_id", "ext", "rank").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "rank", "ext")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("repo_id", "ext", "n")


def repo_map(spark: SparkSession, d: str) -> DataFrame:
    """Top directories of each repository with the kind that their name tells."""
    inner = F.regexp_extract("file_path", r"^/(?:repos|workspace/src)/[^/]+/([^/]+)/", 1)
    kind = F.when(inner.rlike("^(test|tests|it)$"), "tests").when(inner.rlike("^(docs?|site)$"), "docs").when(inner.rlike("^(vendor|third_party|node_modules|external|deps|libs)$"), "vendored").when(inner.rlike("^(tools|scripts|builders)$"), "tooling").otherwise("code")
    return _src(spark, d, "repo_id", "file_path").select("repo_id", inner.alias("top"), kind.alias("purpose")).groupBy("repo_id", "top", "purpose").agg(F.count("*").alias("n_files"))


def skipped_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files left after excluded directories, by arrays of path parts."""
    skip = F.array(*[F.lit(x) for x in ("node_modules", "vendor", "build", "target", "dist", "out", ".git", "__pycache__")])
    return _src(spark, d, "repo_id", "file_path").where(~F.arrays_overlap(F.split("file_path", "/"), skip)).groupBy("repo_id").agg(F.count("*").alias("n_files"))


def modules_by_build_tool(spark: SparkSession, d: str) -> DataFrame:
    """Modules by build tool."""
    return _mod(spark, d).groupBy("repo_id", F.coalesce("build_tool", F.lit("unknown")).alias("build_tool")).agg(F.count("*").alias("n"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row for each kind of node, a union of counts."""
    one = lambda label, df: df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
    return one("Class", _cls(spark, d)).unionByName(one("Method", _mth(spark, d))).unionByName(one("Field", _fld(spark, d))).unionByName(one("Module", _mod(spark, d)))


def expected_minus_actual(spark: SparkSession, d: str) -> DataFrame:
    """Files that symbols name, less those that exist with content."""
    expected = read(spark, d, "symbols", "repo_id", "file_path").distinct()
    return expected.exceptAll(_src(spark, d, "repo_id", "file_path", "content").where("content is not null").select("repo_id", "file_path").distinct())


def signal_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Classes in a directory of generators' output whose name ends like a factory."""
    c = _cls(spark, d)
    made = c.where(F.col("file_path").rlike("/(_*generated_*|gen|src-gen|autogen|out|dist|generated-sources)/")).select("repo_id", "fqn")
    return made.intersect(c.where(F.col("name").rlike("(Helper|Writer|Factory|Builder|Controller|Repository|Service|Scheduler|Client|Adapter)$")).select("repo_id", "fqn"))


def snapshot_methods(spark: SparkSession, d: str) -> DataFrame:
    """Up to ten methods of each class as one ordered list, with the number of all."""
    m = _mth(spark, d).select("repo_id", "class_fqn", "name").distinct().groupBy("repo_id", "class_fqn").agg(F.sort_array(F.collect_set("name")).alias("all"))
    return m.select("repo_id", "class_fqn", F.array_join(F.slice("all", 1, 10), ",").alias("methods"), F.size("all").cast("long").alias("n_all"))


def substantive_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods that are no accessors and longer than three lines, by class."""
    m = _mth(spark, d).where(~F.col("name").rlike("^(get|set|is)[A-Z]") & (F.col("end_line") - F.col("start_line") > 3))
    return m.groupBy("repo_id", "class_fqn").agg(F.count("*").alias("n"), F.max(F.col("end_line") - F.col("start_line")).alias("longest"))


def parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    size = F.coalesce(F.array_size("parameters"), F.lit(0))
    return _mth(spark, d).groupBy(size.cast("long").alias("n_parameters")).agg(F.count("*").alias("n"))


def method_name_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of method names, split where the case or an underscore changes it."""
    words = F.split(F.lower(F.regexp_replace("name", r"([a-z])([A-Z])", "$1_$2")), "_")
    return _mth(spark, d).select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    ident = F.concat(F.lit("auto-"), F.substring(F.sha1(F.concat_ws(":", "repo_id", "fqn")), 1, 8))
    return _cls(spark, d).select("repo_id", "fqn", ident.alias("stable_id")).distinct()


def loc_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    loc = F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0))
    tokens = F.greatest(F.lit(100), F.floor(loc * 2.5))
    return _cls(spark, d).where("start_line is not null and end_line is not null").select("repo_id", "fqn", loc.alias("loc"), tokens.cast("long").alias("tokens")).distinct()


def cross_layer_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports from a web package into a store package, which layers forbid."""
    targets = imported(spark, d).where("file_path like '%/web/%'")
    return targets.where(F.col("target").rlike(r"^com\.[a-z]+\.(archive|ledger|quota)\.")).select("repo_id", "file_path", "target").distinct()


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Scans by id, the finished form winning over the running one."""
    scans = read(spark, d, "scan_log", "id", "repo_id", "status", "finished_at")
    old, new = scans.where("finished_at is null"), scans.where("finished_at is not null")
    return graph.upsert(old, new, ["id"], "finished_at").select("id", "repo_id", "status")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of modules, and those of scans that have no module."""
    old = _mod(spark, d).select("repo_id").distinct().withColumn("origin", F.lit("modules"))
    new = read(spark, d, "scan_log", "repo_id").where("repo_id is not null").distinct().withColumn("origin", F.lit("scans"))
    return graph.insert_absent(old, new, ["repo_id"])


def registry_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of modules against those of scans: indexed, orphaned or never scanned."""
    a = _mod(spark, d).groupBy("repo_id").agg(F.count("*").alias("n_modules"))
    b = read(spark, d, "scan_log", "id", "repo_id").distinct().where("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n_scans"))
    state = F.when(F.col("n_scans").isNull(), "never scanned").when(F.col("n_modules").isNull(), "orphaned").otherwise("indexed")
    return a.join(b, "repo_id", "full_outer").select("repo_id", F.coalesce("n_modules", F.lit(0)).alias("n_modules"), F.coalesce("n_scans", F.lit(0)).alias("n_scans"), state.alias("state"))


def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Classes left when the files of one language go."""
    gone = _src(spark, d, "repo_id", "file_path").where(F.col("file_path").endswith(".py"))
    nodes, _ = graph.delete_files(_cls(spark, d).select("repo_id", "fqn", "file_path"), spark.createDataFrame([], "repo_id string, source string, target string"), gone)
    return nodes.groupBy("repo_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    module_dependency_matrix, types_per_package, distinct_packages, packages_over_threshold, large_package_untested, file_loc_rollup, methods_per_class, god_classes, classes_without_methods, classes_with_static_methods, annotated_members, duplicate_names, overloads, public_undocumented,
    module_class_counts, longest_prefix_owner, module_tree, module_summary, import_fan, external_stubs, resolve_names_unique, resolve_names_as_coded, return_type_counts, role_counts, role_classify, hygiene_class, hygiene_repo, hygiene_grouping_sets, tier_pivot, pattern_matches, pattern_top_packages,
    missing_variant, classes_with_namesake_stem, field_type_counts, class_page, subsystem_histogram, class_search, language_by_repo, repo_map, skipped_paths, modules_by_build_tool, label_counts, expected_minus_actual, signal_intersection, snapshot_methods, substantive_methods, parameter_counts, method_name_words, stable_ids, loc_and_tokens,
    cross_layer_imports, upsert_latest, insert_if_absent, registry_full_outer, delete_by_file,
)}

_ROLE = scoring.ROLE_SQL
_IMPORTS = "imp AS (SELECT repo_id, file_path, unnest(regexp_extract_all(content, 'import ([a-z][\\w.]*\\.[A-Z]\\w*);', 1)) AS target FROM src WHERE content IS NOT NULL)"
_PKG = "CASE WHEN instr({0}, '.') > 0 THEN regexp_replace({0}, '\\.[^.]*$', '') ELSE '' END"
_SIMPLE = "split_part({0}, '.', -1)"
_PAT = ", " + scoring.PATTERNS_SQL
_RAW = """, raw AS (SELECT DISTINCT repo_id, c.fqn AS source, n.name FROM (SELECT repo_id, file_path,
    unnest(regexp_extract_all(content, '(?:import [\\w.]*\\.|import \\{ |from \\w+ import )([A-Z]\\w*)', 1)) AS name FROM src WHERE content IS NOT NULL) n
    JOIN cls c USING (repo_id, file_path))"""
_OWN = ", own AS (SELECT DISTINCT f.repo_id, f.file_path, m.path FROM (SELECT DISTINCT repo_id, file_path FROM src) f JOIN mod m ON f.repo_id = m.repo_id AND starts_with(f.file_path, m.path || '/'))"
SQL = {k: _CTE + v for k, v in {
    "types_per_package": "SELECT repo_id, package_fqn, count(*) AS n_types FROM cls GROUP BY ALL",
    "distinct_packages": f"SELECT DISTINCT repo_id, package_fqn, {_SIMPLE.format('package_fqn')} AS name FROM cls",
    "packages_over_threshold": "SELECT repo_id, package_fqn, count(*) AS n_types FROM cls GROUP BY ALL HAVING count(*) > 3",
    "large_package_untested": "SELECT repo_id, package_fqn, count(*) AS n_types, count(*) FILTER (regexp_matches(name, '(Test|Tests|IT|TestCase|Spec)$')) AS n_tests FROM cls GROUP BY ALL HAVING count(*) >= 3 AND n_tests = 0",
    "file_loc_rollup": "SELECT repo_id, count(*) AS n_files, CAST(sum(l) AS BIGINT) AS loc FROM (SELECT repo_id, file_path, max(end_line) AS l FROM symbols WHERE end_line IS NOT NULL GROUP BY ALL) GROUP BY repo_id",
    "methods_per_class": "SELECT c.repo_id, c.fqn, count(m.name) AS n_methods FROM (SELECT DISTINCT repo_id, fqn FROM cls) c LEFT JOIN mth m ON c.repo_id = m.repo_id AND c.fqn = m.class_fqn GROUP BY ALL",
    "god_classes": "SELECT c.repo_id, c.fqn, m.n AS n_methods, f.n AS n_fields FROM (SELECT DISTINCT repo_id, fqn FROM cls WHERE NOT contains(fqn, 'Test') AND NOT contains(fqn, '$')) c JOIN (SELECT repo_id, class_fqn, count(*) AS n FROM mth GROUP BY ALL) m ON m.repo_id = c.repo_id AND m.class_fqn = c.fqn JOIN (SELECT repo_id, class_fqn, count(DISTINCT name) AS n FROM fld GROUP BY ALL) f ON f.repo_id = c.repo_id AND f.class_fqn = c.fqn WHERE m.n > 30 AND f.n > 0",
    "classes_without_methods": "SELECT DISTINCT repo_id, fqn FROM cls c WHERE NOT EXISTS (SELECT 1 FROM mth m WHERE m.repo_id = c.repo_id AND m.class_fqn = c.fqn)",
    "classes_with_static_methods": "SELECT DISTINCT repo_id, fqn, name FROM cls c WHERE EXISTS (SELECT 1 FROM mth m WHERE m.repo_id = c.repo_id AND m.class_fqn = c.fqn AND list_contains(m.modifiers, 'static'))",
    "annotated_members": "SELECT repo_id, fqn, len(annotations) AS n_annotations FROM mth WHERE len(list_filter(annotations, lambda a: contains(a, 'Cache') OR contains(a, 'Transactional'))) > 0",
    "duplicate_names": "SELECT repo_id, name, fqn, first, n FROM (SELECT *, min(fqn) OVER w AS first, count(*) OVER w AS n FROM (SELECT DISTINCT repo_id, name, fqn FROM cls) WINDOW w AS (PARTITION BY repo_id, name)) WHERE n > 1",
    "overloads": "SELECT repo_id, fqn, count(*) AS n FROM mth GROUP BY ALL HAVING count(*) > 1",
    "public_undocumented": "SELECT repo_id, class_fqn, count(*) AS n FROM mth WHERE list_contains(modifiers, 'public') AND docstring IS NULL GROUP BY ALL HAVING count(*) >= 3",
    "module_class_counts": "SELECT m.repo_id, m.path, count(f.file_path) AS n_files FROM (SELECT DISTINCT repo_id, path FROM mod) m LEFT JOIN (SELECT DISTINCT repo_id, file_path FROM src) f ON f.repo_id = m.repo_id AND starts_with(f.file_path, m.path || '/') GROUP BY ALL",
    "module_tree": "SELECT a.repo_id, a.path, arg_max(b.path, length(b.path)) AS parent, count(b.path) AS depth FROM (SELECT DISTINCT repo_id, path FROM mod) a LEFT JOIN (SELECT DISTINCT repo_id, path FROM mod) b ON a.repo_id = b.repo_id AND starts_with(a.path, b.path || '/') GROUP BY ALL",
    "return_type_counts": "SELECT trim(split_part(return_type, '<', 1)) AS type_base, count(*) AS n_methods FROM mth WHERE return_type IS NOT NULL GROUP BY ALL",
    "role_counts": f"SELECT {_ROLE} AS role, count(*) AS n FROM cls GROUP BY ALL",
    "role_classify": f"SELECT DISTINCT repo_id, fqn, {_ROLE} AS role FROM cls",
    "missing_variant": "SELECT DISTINCT repo_id, name, regexp_replace(name, 'Reader$', 'Writer') AS missing FROM cls c WHERE name LIKE '%Reader' AND NOT EXISTS (SELECT 1 FROM cls o WHERE o.repo_id = c.repo_id AND o.name = regexp_replace(c.name, 'Reader$', 'Writer'))",
    "classes_with_namesake_stem": "SELECT DISTINCT repo_id, base, name FROM (SELECT repo_id, name, regexp_replace(name, '(Adapter|Builder|Client|Handler|Helper|Job|Service|Reader|Writer|Test)$', '') AS base FROM cls) c WHERE base <> name AND base <> '' AND EXISTS (SELECT 1 FROM cls o WHERE o.repo_id = c.repo_id AND o.name = c.base)",
    "field_type_counts": "SELECT trim(split_part(type_name, '<', 1)) AS type_base, count(*) AS n, count(DISTINCT class_fqn) AS n_classes FROM fld WHERE type_name IS NOT NULL GROUP BY ALL",
    "class_page": "SELECT DISTINCT repo_id, fqn, name FROM cls ORDER BY name, fqn, repo_id LIMIT 50 OFFSET 50",
    "subsystem_histogram": "SELECT array_to_string(string_split(fqn, '.')[1:3], '.') AS subsystem, count(*) AS n FROM cls GROUP BY ALL",
    "class_search": "SELECT DISTINCT repo_id, fqn, name FROM cls WHERE contains(lower(name), 'policy')",
    "language_by_repo": "SELECT repo_id, ext, n FROM (SELECT repo_id, lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, CASE ext WHEN 'java' THEN 1 WHEN 'py' THEN 2 WHEN 'js' THEN 3 WHEN 'ts' THEN 4 ELSE 9 END, ext) AS k FROM (SELECT DISTINCT repo_id, file_path FROM src) GROUP BY repo_id, ext) WHERE k = 1",
    "repo_map": "SELECT repo_id, top, CASE WHEN regexp_matches(top, '^(test|tests|it)$') THEN 'tests' WHEN regexp_matches(top, '^(docs?|site)$') THEN 'docs' WHEN regexp_matches(top, '^(vendor|third_party|node_modules|external|deps|libs)$') THEN 'vendored' WHEN regexp_matches(top, '^(tools|scripts|builders)$') THEN 'tooling' ELSE 'code' END AS purpose, count(*) AS n_files FROM (SELECT DISTINCT repo_id, file_path, regexp_extract(file_path, '^/(?:repos|workspace/src)/[^/]+/([^/]+)/', 1) AS top FROM src) GROUP BY ALL",
    "skipped_paths": "SELECT repo_id, count(*) AS n_files FROM (SELECT DISTINCT repo_id, file_path FROM src) WHERE NOT list_has_any(string_split(file_path, '/'), ['node_modules', 'vendor', 'build', 'target', 'dist', 'out', '.git', '__pycache__']) GROUP BY ALL",
    "modules_by_build_tool": "SELECT repo_id, coalesce(build_tool, 'unknown') AS build_tool, count(*) AS n FROM mod GROUP BY ALL",
    "label_counts": "SELECT 'Class' AS label, count(*) AS n FROM cls UNION ALL SELECT 'Method', count(*) FROM mth UNION ALL SELECT 'Field', count(*) FROM fld UNION ALL SELECT 'Module', count(*) FROM mod",
    "expected_minus_actual": "SELECT DISTINCT repo_id, file_path FROM symbols EXCEPT SELECT repo_id, file_path FROM src WHERE content IS NOT NULL",
    "signal_intersection": "SELECT repo_id, fqn FROM cls WHERE regexp_matches(file_path, '/(_*generated_*|gen|src-gen|autogen|out|dist|generated-sources)/') INTERSECT SELECT repo_id, fqn FROM cls WHERE regexp_matches(name, '(Helper|Writer|Factory|Builder|Controller|Repository|Service|Scheduler|Client|Adapter)$')",
    "snapshot_methods": "SELECT repo_id, class_fqn, array_to_string(list_sort(list(DISTINCT name))[1:10], ',') AS methods, count(DISTINCT name) AS n_all FROM mth GROUP BY ALL",
    "substantive_methods": "SELECT repo_id, class_fqn, count(*) AS n, max(end_line - start_line) AS longest FROM mth WHERE NOT regexp_matches(name, '^(get|set|is)[A-Z]') AND end_line - start_line > 3 GROUP BY ALL",
    "parameter_counts": "SELECT coalesce(len(parameters), 0) AS n_parameters, count(*) AS n FROM mth GROUP BY ALL",
    "method_name_words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '_')) AS word FROM mth) WHERE word <> '' GROUP BY ALL",
    "stable_ids": "SELECT DISTINCT repo_id, fqn, 'auto-' || substr(sha1(repo_id || ':' || fqn), 1, 8) AS stable_id FROM cls",
    "loc_and_tokens": "SELECT DISTINCT repo_id, fqn, greatest(end_line - start_line, 0) AS loc, greatest(100, CAST(floor(greatest(end_line - start_line, 0) * 2.5) AS BIGINT)) AS tokens FROM cls WHERE start_line IS NOT NULL AND end_line IS NOT NULL",
    "insert_if_absent": "SELECT DISTINCT repo_id, 'modules' AS origin FROM mod UNION ALL SELECT DISTINCT repo_id, 'scans' FROM scan_log WHERE repo_id IS NOT NULL AND repo_id NOT IN (SELECT repo_id FROM mod)",
    "upsert_latest": "SELECT DISTINCT id, repo_id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at DESC NULLS LAST) AS k FROM scan_log) WHERE k = 1",
    "registry_full_outer": "SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(n_modules, 0) AS n_modules, coalesce(n_scans, 0) AS n_scans, CASE WHEN n_scans IS NULL THEN 'never scanned' WHEN n_modules IS NULL THEN 'orphaned' ELSE 'indexed' END AS state FROM (SELECT repo_id, count(*) AS n_modules FROM mod GROUP BY 1) a FULL JOIN (SELECT repo_id, count(DISTINCT id) AS n_scans FROM scan_log WHERE repo_id IS NOT NULL GROUP BY 1) b ON a.repo_id = b.repo_id",
    "delete_by_file": "SELECT repo_id, count(*) AS n FROM cls c WHERE NOT (file_path LIKE '%.py' AND EXISTS (SELECT 1 FROM src s WHERE s.repo_id = c.repo_id AND s.file_path = c.file_path)) GROUP BY ALL",
}.items()}
SQL["longest_prefix_owner"] = _CTE + _OWN + " SELECT repo_id, file_path, arg_max(path, length(path)) AS path FROM own GROUP BY ALL"
SQL["module_summary"] = _CTE + _OWN + """, inn AS (SELECT repo_id, file_path, arg_max(path, length(path)) AS path FROM own GROUP BY ALL),
    n AS (SELECT c.repo_id, c.fqn, c.file_path, count(m.name) AS n FROM (SELECT DISTINCT repo_id, fqn, file_path FROM cls) c LEFT JOIN mth m ON m.repo_id = c.repo_id AND m.class_fqn = c.fqn GROUP BY ALL)
    SELECT n.repo_id, path, count(*) AS n_classes, round(avg(n), 3) AS avg_methods, max(n) AS max_methods FROM n JOIN inn USING (repo_id, file_path) GROUP BY n.repo_id, path"""
SQL["module_dependency_matrix"] = _CTE + ", " + _IMPORTS + f""", e AS (SELECT {_SIMPLE.format('c.package_fqn')} AS from_group, {_SIMPLE.format('(' + _PKG.format('i.target') + ')')} AS to_group
    FROM imp i JOIN (SELECT DISTINCT repo_id, file_path, package_fqn FROM cls) c USING (repo_id, file_path))
    SELECT from_group, to_group, count(*) AS n FROM e WHERE from_group <> to_group GROUP BY from_group, to_group ORDER BY n DESC, from_group, to_group LIMIT 40"""
SQL["import_fan"] = _CTE + ", " + _IMPORTS + f" SELECT {_PKG.format('target')} AS package_fqn, count(*) AS n_imports, count(DISTINCT file_path) AS fan_in FROM (SELECT DISTINCT file_path, target FROM imp) GROUP BY ALL"
SQL["external_stubs"] = _CTE + ", " + _IMPORTS + f" SELECT DISTINCT repo_id, target AS fqn, {_SIMPLE.format('target')} AS name, {_PKG.format('target')} AS package_fqn FROM imp i WHERE NOT EXISTS (SELECT 1 FROM cls c WHERE c.repo_id = i.repo_id AND c.fqn = i.target)"
SQL["cross_layer_imports"] = _CTE + ", " + _IMPORTS + " SELECT DISTINCT repo_id, file_path, target FROM imp WHERE file_path LIKE '%/web/%' AND regexp_matches(target, '^com\\.[a-z]+\\.(archive|ledger|quota)\\.')"
SQL["resolve_names_unique"] = _CTE + _RAW + " SELECT DISTINCT repo_id, r.source, t.target FROM raw r JOIN (SELECT repo_id, name, min(fqn) AS target FROM cls GROUP BY repo_id, name HAVING count(DISTINCT fqn) = 1) t USING (repo_id, name) WHERE r.source <> t.target"
SQL["resolve_names_as_coded"] = _CTE + _RAW + " SELECT DISTINCT repo_id, r.source, c.fqn AS target FROM raw r JOIN cls c USING (repo_id, name) WHERE r.source <> c.fqn"
SQL["pattern_matches"] = _CTE + _PAT + " SELECT * FROM pat"
SQL["pattern_top_packages"] = _CTE + _PAT + f" SELECT * FROM (SELECT pattern_id, {_PKG.format('fqn')} AS package_fqn, count(*) AS n, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, {_PKG.format('fqn')}) AS k FROM pat GROUP BY pattern_id, {_PKG.format('fqn')}) WHERE k <= 5"
