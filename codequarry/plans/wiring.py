"""Queries over the derived code graph: edges from names, rules in words, the impact of changes, scores, and tables kept up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import graph as nodes
from codequarry.operators import impact, scoring, wording
from codequarry.plans import model
from codequarry.tables import cut

SENTENCES = {
    "path": "Services in 'mod1' module must not directly call 'mod2'.", "layer": "mod3 layer must not depend on mod4", "annotated": "All classes in mod5 module must have annotation @Audited", "controllers": "Controllers must not directly call repositories", "extends": "Service classes must not extend SmallRingConfig",
    "public": "All public methods in mod6 must be annotated with @Audited", "none": "Please write nice code",
}


def rules_in_words(spark: SparkSession, d: str) -> DataFrame:
    """Violators of one rule of each phrasing; a sentence that fits none has no rows."""
    return wording.run(model.graph(spark, d), SENTENCES)


def _deprecated(cls):
    """Files of deprecated classes as changes, one change for each module of a repository: what their removal would touch."""
    own = cls.where(F.exists("annotations", lambda a: a.contains("Deprecated")))
    return own.select(F.concat_ws(":", "repo_id", "module").alias("change_id"), "repo_id", "file_path").distinct()


def _touched(spark, d):
    g = model.import_graph(spark, d)
    return impact.components(g, impact.Surroundings(model.endpoints(spark, d, g.cls), model.policies(spark, d), model.violates(spark, d, g.cls)), _deprecated(g.cls))


def change_components(spark: SparkSession, d: str) -> DataFrame:
    """All that the removal of the deprecated classes of each module touches."""
    return _touched(spark, d)


def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each component and the risk of each such change."""
    return impact.summary(_touched(spark, d))


def supertypes_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Names of field types as edges: by a name that one class of the repository bears, else by the classes that the source imports."""
    raw = model.fields(spark, d).where("type_name <> 'Node*'").select("repo_id", F.col("class_fqn").alias("source"), F.regexp_extract("type_name", r"^(?:List<)?([^>]*)>?$", 1).alias("name"))
    cls = model.classes(spark, d).select("repo_id", "name", "fqn")
    first = nodes.resolve_unique(raw, cls)
    second = nodes.resolve_imported(raw, cls, model.edges(spark, d).where("type = 'IMPORTS'"), first)
    return first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))


def calls_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Calls by bare name as edges: to another method of the class, else to the only method of that name in the package."""
    m, c = model.methods(spark, d), model.classes(spark, d)
    package = c.select("repo_id", F.col("fqn").alias("class_fqn"), "package_fqn")
    raw = model.calls(spark, d).select("repo_id", "caller", F.substring_index("caller", "#", 1).alias("class_fqn"), F.substring_index("callee", "#", -1).alias("name")).distinct()
    first = nodes.calls_same_class(raw, m)
    second = nodes.calls_same_package(raw.join(package, ["repo_id", "class_fqn"]), m.join(package, ["repo_id", "class_fqn"]), first)
    return first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))


def tests_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Classes of no test with the number of tests whose name holds theirs, and the first of these."""
    cls = model.classes(spark, d).select("repo_id", "fqn", "name").distinct()
    ends = F.col("name").endswith("Test") | F.col("name").endswith("Spec")
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda a: F.transform(F.sequence(F.lit(1), F.length("name") - a + 1), lambda n: F.substring("name", a, n)))))
    tests = cls.where(ends).select("repo_id", F.col("fqn").alias("test"), F.explode(pieces).alias("name"))
    return cls.where(~ends).join(tests, ["repo_id", "name"]).groupBy("repo_id", "fqn").agg(F.countDistinct("test").alias("n_tests"), F.min("test").alias("first_test"))


def field_types_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The class that each field's type names, generics stripped: of several one of the own module, then the least name."""
    cls = model.classes(spark, d).select("repo_id", "name", "fqn", "module")
    f = model.fields(spark, d).select("repo_id", "class_fqn", F.col("name").alias("field"), F.trim(F.regexp_replace("type_name", "^List<|>$", "")).alias("name")).distinct()
    own = cls.select("repo_id", F.col("fqn").alias("class_fqn"), F.col("module").alias("own_module"))
    met = f.join(own, ["repo_id", "class_fqn"]).join(cls, ["repo_id", "name"])
    best = F.min(F.struct((F.col("module") != F.col("own_module")).alias("far"), "fqn"))["fqn"]
    return met.groupBy("repo_id", "class_fqn", "field", "name").agg(best.alias("target"))


def path_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of endpoint paths, patterns left out, and the path without them."""
    found = F.regexp_extract_all("path", F.lit(r"\{(\w+)(?::[^}]*)?\}"), F.lit(1))
    return model.endpoints(spark, d).select("fqn", "verb", F.array_join(found, ",").alias("parameters"), F.size(found).cast("long").alias("n"), F.regexp_replace("path", r"\{(\w+)(?::[^}]*)?\}", "{}").alias("shape"))


def _gods(spark, d, methods, fields):
    g = scoring.god_classes(model.classes(spark, d), model.methods(spark, d), model.fields(spark, d), methods, fields)
    return g.select("repo_id", F.concat(F.lit("god_class-"), "repo_id").alias("pattern_id"), "fqn")


def patterns_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Patterns after two repositories were scanned anew with higher bounds: theirs are replaced, those of the others stay."""
    old = _gods(spark, d, 30, 3).withColumn("found_by", F.lit("first"))
    new = _gods(spark, d, 34, 4).where("repo_id <> 'r2'").withColumn("found_by", F.lit("second"))
    return nodes.replace_scope(old, new, ["repo_id"]).groupBy("repo_id", "found_by").agg(F.count("*").alias("n"))


def pattern_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Patterns joined with the catalogue by their id without the repository's suffix, with up to three samples."""
    found = _gods(spark, d, 30, 3)
    key = F.regexp_replace("pattern_id", F.concat(F.lit("-"), F.col("repo_id"), F.lit("$")), F.lit(""))
    w = Window.partitionBy("pattern_id").orderBy("fqn")
    ranked = found.withColumn("id", key).withColumn("k", F.row_number().over(w))
    titles = spark.createDataFrame([("god_class", "God class"), ("factory", "Factory")], "id string, title string")
    got = ranked.groupBy("id", "pattern_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("fqn")))), ",").alias("samples"))
    return titles.join(got, "id", "left").select("id", "title", "pattern_id", F.coalesce("n", F.lit(0)).alias("n"), "samples")


def _insights(spark, d):
    """Customers as insights on the part of their number: even ones name a class, odd ones a file."""
    from codequarry.tables import read

    c = read(spark, d, "customer", F.col("c_custkey").cast("long").alias("k"))
    cls = model.classes(spark, d).select("k", "repo_id", "fqn", "file_path")
    return c.join(cls, "k", "left").select("k", F.when(F.col("k") % 2 == 0, F.col("fqn")).otherwise(F.col("file_path")).alias("applies_to"), (F.col("k") % 6 / 5.0).alias("staleness"))


def insights_aged(spark: SparkSession, d: str) -> DataFrame:
    """Staleness after a change of the deprecated classes' files: 0.2 more where the class or the path is among them, 1 at most."""
    cls = model.classes(spark, d)
    changed = _deprecated(cls).select("file_path").distinct()
    hit = cls.join(changed, "file_path", "left_semi").select(F.col("fqn").alias("applies_to")).unionByName(changed.select(F.col("file_path").alias("applies_to"))).distinct().withColumn("hit", F.lit(True))
    aged = F.when(F.col("hit"), F.least(F.lit(1.0), F.col("staleness") + 0.2)).otherwise(F.col("staleness"))
    return _insights(spark, d).join(hit, "applies_to", "left").select("k", F.round(aged, 4).alias("staleness"))


def insight_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges from insights to classes, only where the class exists."""
    cls = model.classes(spark, d).select("repo_id", F.col("fqn").alias("applies_to"))
    return _insights(spark, d).join(cls, "applies_to").groupBy("repo_id").agg(F.count("*").alias("n"))


def policy_targets(spark: SparkSession, d: str) -> DataFrame:
    """Active policies on modules that exist, and whether anything breaks them."""
    modules = model.classes(spark, d).select("module").distinct()
    broken = model.violates(spark, d).groupBy("policy_id").agg(F.count("*").alias("n"))
    return model.policies(spark, d).where("status = 'active'").join(modules, "module").join(broken, "policy_id", "left").select("policy_id", "module", "severity", (F.coalesce("n", F.lit(0)) > 0).alias("is_violated"))


def module_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Imports between modules of one repository by direction, those of weight 1 left out; outside names count as external."""
    m = model.classes(spark, d).select("repo_id", "fqn", "module").distinct()
    e = model.edges(spark, d).where("type = 'IMPORTS'")
    side = lambda end, name: m.select("repo_id", F.col("fqn").alias(end), F.col("module").alias(name))
    got = e.join(side("source", "a"), ["repo_id", "source"], "left").join(side("target", "b"), ["repo_id", "target"], "left")
    got = got.select("repo_id", F.coalesce("a", F.lit("external")).alias("a"), F.coalesce("b", F.lit("external")).alias("b")).where("a <> b")
    return got.groupBy("repo_id", "a", "b").agg(F.count("*").alias("weight")).where("weight > 1")


def enriched_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of names with its repetitions, each with what is known of it; unknown names stay with nulls."""
    listed = model.violates(spark, d).select(F.posexplode(F.array(F.col("fqn"), F.col("fqn"), F.concat("fqn", F.lit("X")))).alias("at", "fqn"))
    return listed.join(model.classes(spark, d).select("fqn", "kind", "module"), "fqn", "left").select("at", "fqn", "kind", "module")


def changed_with_importers(spark: SparkSession, d: str) -> DataFrame:
    """For each changed file its classes and those that import one of them, both lists in one."""
    cls = model.classes(spark, d)
    own = cls.join(_deprecated(cls).select("file_path").distinct(), "file_path", "left_semi").select("repo_id", "file_path", "fqn")
    importers = model.edges(spark, d).where("type = 'IMPORTS'").select("repo_id", F.col("target").alias("fqn"), F.col("source").alias("by"))
    got = own.join(importers, ["repo_id", "fqn"], "left").groupBy("repo_id", "file_path").agg(F.concat(F.sort_array(F.collect_set("fqn")), F.sort_array(F.collect_set("by"))).alias("all"))
    return got.select("repo_id", "file_path", F.array_join("all", ",").alias("affected"), F.size("all").cast("long").alias("n"))


def packages_by_relation(spark: SparkSession, d: str) -> DataFrame:
    """Packages that relate to deprecated classes: how, by how many classes and the first five; the twenty with most."""
    cls = model.classes(spark, d)
    old = cls.where(F.exists("annotations", lambda a: a.contains("Deprecated"))).select(F.col("fqn").alias("target"))
    met = model.edges(spark, d).join(old, "target", "left_semi").join(cls.select(F.col("fqn").alias("source"), "package_fqn"), "source")
    w = Window.partitionBy("package_fqn").orderBy("source")
    once = met.groupBy("package_fqn", "source").agg(F.collect_set("type").alias("types")).withColumn("k", F.row_number().over(w))
    got = once.groupBy("package_fqn").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("types")))), ",").alias("relations"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.col("source")))), ",").alias("classes"))
    return got.orderBy(F.desc("n"), "package_fqn").limit(20)


def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges of two deliveries, each once by its ends and type."""
    own = model.edges(spark, d)
    called = model.calls(spark, d).select("repo_id", F.lit("USES").alias("type"), F.substring_index("caller", "#", 1).alias("source"), F.substring_index("callee", "#", 1).alias("target"))
    return own.unionByName(called).unionByName(own).dropDuplicates(["repo_id", "type", "source", "target"]).groupBy("repo_id", "type").agg(F.count("*").alias("n"))


def annotations_appended(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of classes that implement an interface, its name appended; a null list counts as empty."""
    cls = model.classes(spark, d)
    faces = model.edges(spark, d).where("type = 'IMPLEMENTS'").join(cls.select(F.col("fqn").alias("target"), F.col("name").alias("face")), "target").select(F.col("source").alias("fqn"), "face")
    added = F.concat(F.coalesce("annotations", F.array().cast("array<string>")), F.array("face"))
    return cls.join(faces, "fqn").select("fqn", F.array_join(added, ",").alias("annotations"))


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Classes of which one of three columns holds a word, whatever its case."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains("ring"), F.lit(False)) for c in ("name", "package_fqn", "javadoc")))
    return model.classes(spark, d).where(hit).groupBy("repo_id", "kind").agg(F.count("*").alias("n"))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Where a repository is entered: in scripts by suffixes of names, elsewhere controllers and handlers."""
    script = F.col("file_path").rlike(r"\.(js|ts)$")
    entry = F.when(script, F.col("name").rlike("(Controller|Client|Job)$")).otherwise(F.col("name").rlike("(Controller|Handler)$"))
    return model.classes(spark, d).where(entry).groupBy("repo_id", script.alias("script")).agg(F.count("*").alias("n"), F.min("fqn").alias("first"))


#: Columns by which a page may be ordered.
ORDERS = {"name": ("name", False), "size": ("n_methods", True), "module": ("module", False)}


def page(df: DataFrame, order: str, number: int, size: int = 50) -> DataFrame:
    """The page ``number`` (from 1) of ``df``, each row with the number of all rows and pages. An unknown order is by name."""
    column, down = ORDERS.get(order, ORDERS["name"])
    total = df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))
    key = F.desc_nulls_last(column) if down else F.asc_nulls_last(column)
    return df.orderBy(key, "fqn").offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def where(df: DataFrame, **conditions) -> DataFrame:
    """``df`` by those conditions that are given: equality, membership for a list, a substring for a name that ends in _like."""
    for name, value in conditions.items():
        if value is None:
            continue
        if name.endswith("_like"):
            df = df.where(F.lower(F.col(name[:-5])).contains(value.lower()))
        else:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def class_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first page of classes and enums of one name, by number of methods, filters that aren't given left out."""
    n = model.methods(spark, d).groupBy(F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n_methods"))
    cls = model.classes(spark, d).join(n, "fqn", "left").withColumn("n_methods", F.coalesce("n_methods", F.lit(0)))
    return page(where(cls, kind=["class", "enum"], name_like="ring", module=None), "size", 1, 10).select("fqn", "n_methods", "total", "pages")


def _scored(spark, d):
    cls, m, f = model.classes(spark, d), model.methods(spark, d), model.fields(spark, d)
    return scoring.whole_scores(scoring.enriched(cls, m, f, cut(model.edges(spark, d).select("repo_id", "source", "target").distinct())))


def hygiene_scores(spark: SparkSession, d: str) -> DataFrame:
    """The four scores of each class of the derived graph, their sum, grade, tier and warnings."""
    return _scored(spark, d).select("repo_id", "fqn", "n_methods", "fan_in", "fan_out", "blast_size", "size_score", "blast_score", "coupling_score", "docs_score", "score", "grade", "tier", F.size("warnings").cast("long").alias("n_warnings"))


def hygiene_scores_repo(spark: SparkSession, d: str) -> DataFrame:
    """Scores of repositories, tests and generated classes left out of the mean, and what god classes cost."""
    return scoring.whole_repo_scores(_scored(spark, d)).select("repo_id", "n_classes", "n_scored", "n_god", "penalty", "score", "grade", "n_a", "n_b", "n_c", "n_d", "n_f", "tokens")


def refactor_order(spark: SparkSession, d: str) -> DataFrame:
    """Classes by the benefit of refactoring them, with the reasons that hold; the fifty with most."""
    return _scored(spark, d).orderBy(F.desc("benefit"), "fqn").limit(50).select("fqn", "benefit", F.array_join("reasons", ",").alias("reasons"))


def refactor_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every class with the reasons to refactor it, by rank."""
    return _scored(spark, d).where(F.size("reasons") > 0).select("fqn", "tier", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    rules_in_words, change_components, change_summary, supertypes_resolved, calls_resolved, tests_by_name, field_types_resolved, path_parameters, patterns_replaced, pattern_catalogue, insights_aged, insight_links, policy_targets, module_pairs, enriched_list, changed_with_importers, packages_by_relation, edge_upsert,
    annotations_appended, text_search, entry_points, class_pages, hygiene_scores, hygiene_scores_repo, refactor_order, refactor_reasons,
)}

_C = model.CTE
_IMPORTS = "(SELECT DISTINCT repo_id, source, target FROM edge WHERE type = 'IMPORTS')"
_OLD = "len(list_filter(coalesce(annotations, []), lambda a: contains(a, 'Deprecated'))) > 0"
_USES = "use AS (SELECT repo_id, source, target FROM edge WHERE type = 'IMPORTS' UNION SELECT repo_id, split_part(caller, '#', 1), split_part(callee, '#', 1) FROM call)"


def _three(sources: str, targets: str) -> str:
    return f"SELECT DISTINCT s.repo_id, s.fqn AS violator FROM cls s WHERE {sources} AND s.fqn IN (SELECT a.source FROM use a JOIN cls t ON t.fqn = a.target WHERE {targets} UNION SELECT a.source FROM use a JOIN use b ON b.source = a.target JOIN cls t ON t.fqn = b.target WHERE {targets} UNION SELECT a.source FROM use a JOIN use b ON b.source = a.target JOIN use c ON c.source = b.target JOIN cls t ON t.fqn = c.target WHERE {targets})"


_CHANGE = f"""chg AS (SELECT DISTINCT repo_id || ':' || module AS change_id, repo_id, file_path FROM cls WHERE {_OLD}),
dir AS (SELECT DISTINCT change_id, c.repo_id, fqn FROM chg JOIN cls c USING (repo_id, file_path)),
clr AS (SELECT DISTINCT change_id, d.repo_id, split_part(caller, '#', 1) AS fqn FROM dir d JOIN call ON split_part(callee, '#', 1) = d.fqn EXCEPT SELECT * FROM dir),
hop AS (SELECT change_id, repo_id, fqn, 0 AS h FROM dir UNION SELECT change_id, e.repo_id, source, h + 1 FROM hop JOIN edge e ON e.target = hop.fqn AND e.type = 'IMPORTS' WHERE h < 4),
dep AS (SELECT change_id, repo_id, fqn, min(h) AS h FROM hop GROUP BY ALL HAVING min(h) > 0),
hit AS (SELECT change_id, fqn FROM dir UNION SELECT change_id, fqn FROM clr UNION SELECT change_id, fqn FROM dep),
mdl AS (SELECT DISTINCT change_id, c.repo_id, module FROM hit JOIN cls c USING (fqn)),
pol AS (SELECT DISTINCT change_id, policy_id, severity || ':' || CASE WHEN policy_id IN (SELECT policy_id FROM violate) THEN 'violated' ELSE 'kept' END AS detail FROM mdl JOIN policy USING (module) WHERE status = 'active'),
tst AS (SELECT change_id, t.fqn, min(r) AS r FROM (SELECT change_id, t.fqn, 0 AS r FROM dir d JOIN cls t ON t.repo_id = d.repo_id AND contains(t.name, split_part(d.fqn, '.', -1)) UNION ALL SELECT change_id, t.fqn, 1 FROM mdl m JOIN cls t USING (repo_id, module)) t JOIN cls c ON c.fqn = t.fqn WHERE c.name LIKE '%Test' OR c.name LIKE '%Tests' OR c.name LIKE '%Spec' GROUP BY ALL),
cmp AS (SELECT change_id, 'direct' AS component, fqn AS key, 0 AS hops, CAST(0.85 AS DOUBLE) AS confidence, '' AS detail FROM dir UNION ALL SELECT change_id, 'caller', fqn, 1, 0.80, '' FROM clr UNION ALL SELECT change_id, 'dependent', fqn, h, 0.75, '' FROM dep
    UNION ALL SELECT DISTINCT change_id, 'endpoint', verb || ' ' || path, NULL, 0.90, '' FROM dir JOIN endpoint USING (fqn) UNION ALL SELECT change_id, 'module', module, NULL, NULL, '' FROM mdl
    UNION ALL SELECT change_id, 'policy', policy_id, NULL, NULL, detail FROM pol UNION ALL SELECT change_id, 'test', fqn, NULL, NULL, CASE r WHEN 0 THEN 'name-match' ELSE 'same-module' END FROM tst)"""
_NAMED = "(SELECT DISTINCT repo_id, class_fqn AS source, regexp_extract(type_name, '^(?:List<)?([^>]*)>?$', 1) AS name FROM fld WHERE type_name <> 'Node*')"
_FAN = """, bk(node, dep) AS (SELECT DISTINCT target, source FROM edge WHERE source <> target UNION SELECT b.node, e.source FROM bk b JOIN edge e ON e.target = b.dep WHERE e.source <> b.node),
pair AS (SELECT DISTINCT repo_id, source, target FROM edge), one AS (SELECT repo_id, fqn, min(name) AS name, max(CASE WHEN javadoc IS NULL THEN 0 ELSE 1 END) AS doc, arg_min(kind, file_path) AS kind, min(file_path) AS file_path FROM cls GROUP BY ALL),
fan AS (SELECT o.*, coalesce((SELECT count(*) FROM mth m WHERE m.class_fqn = o.fqn), 0) AS n_methods, coalesce(i.n, 0) AS fan_in, coalesce(u.n, 0) AS fan_out, least(coalesce(b.n, 0), 500) AS blast_size FROM one o LEFT JOIN (SELECT target, count(*) AS n FROM pair GROUP BY 1) i ON i.target = o.fqn LEFT JOIN (SELECT source, count(*) AS n FROM pair GROUP BY 1) u ON u.source = o.fqn LEFT JOIN (SELECT node, count(*) AS n FROM bk GROUP BY 1) b ON b.node = o.fqn),
cpl AS (SELECT *, round_even(least(1.0, CAST(0.5 AS DOUBLE) * fan_in / greatest(max(fan_in) OVER w, 1) + CAST(0.25 AS DOUBLE) * fan_out / greatest(max(fan_out) OVER w, 1) + CAST(0.25 AS DOUBLE) * least(n_methods / 50.0, 1.0)), 4) AS coupling FROM fan WINDOW w AS (PARTITION BY repo_id)),
sc0 AS (SELECT *, CASE WHEN n_methods <= 10 THEN 25 WHEN n_methods <= 20 THEN 18 WHEN n_methods <= 30 THEN 10 WHEN n_methods <= 60 THEN 4 ELSE 0 END AS size_score,
    CASE WHEN blast_size = 0 THEN 25 WHEN blast_size <= 5 THEN 20 WHEN blast_size <= 20 THEN 12 WHEN blast_size <= 50 THEN 5 WHEN blast_size <= 100 THEN 2 ELSE 0 END AS blast_score,
    CASE WHEN coupling < 0.10 THEN 25 WHEN coupling < 0.20 THEN 20 WHEN coupling < 0.35 THEN 12 WHEN coupling < 0.50 THEN 6 ELSE 0 END AS coupling_score, doc * 25 AS docs_score FROM cpl),
sc1 AS (SELECT *, size_score + blast_score + coupling_score + docs_score AS score FROM sc0),
sc AS (SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade,
    CASE WHEN n_methods > 60 OR blast_size > 100 THEN 'god' WHEN n_methods > 30 OR blast_size > 50 THEN 'large' WHEN n_methods > 15 THEN 'medium' WHEN n_methods > 5 THEN 'small' ELSE 'tiny' END AS tier,
    CAST(coupling >= 0.7 AS INT) + CAST(blast_size > 20 AS INT) AS n_warnings, CASE WHEN score >= 80 THEN 500 WHEN score >= 60 THEN 900 WHEN score >= 40 THEN 1750 WHEN score >= 20 THEN 3500 ELSE 7500 END AS tok,
    regexp_matches(name, '(Test|Tests|IT|TestCase|Spec)$') AS is_test FROM sc1)"""
SQL = {
    "rules_in_words": _C + ", " + _USES + ", v(policy, repo_id, violator) AS (SELECT 'path', * FROM (" + _three("s.module = 'mod1'", "t.module = 'mod2'") + f") UNION ALL SELECT DISTINCT 'layer', e.repo_id, a.fqn FROM edge e JOIN cls a ON a.fqn = e.source JOIN cls b ON b.fqn = e.target WHERE type = 'IMPORTS' AND a.module = 'mod3' AND b.module = 'mod4' UNION ALL SELECT 'annotated', repo_id, fqn FROM cls WHERE module = 'mod5' AND NOT list_contains(coalesce(annotations, []), 'Audited') UNION ALL SELECT 'controllers', * FROM ("
    + _three("contains(lower(s.name), 'controller')", "contains(lower(t.name), 'repository')") + ") UNION ALL SELECT DISTINCT 'extends', e.repo_id, a.fqn FROM edge e JOIN cls a ON a.fqn = e.source JOIN cls b ON b.fqn = e.target WHERE type = 'EXTENDS' AND contains(lower(a.name), 'service') AND b.name = 'SmallRingConfig' UNION ALL SELECT DISTINCT 'public', m.repo_id, m.fqn FROM mth m JOIN cls c ON c.fqn = m.class_fqn WHERE c.module = 'mod6' AND list_contains(m.modifiers, 'public') AND NOT list_contains(m.annotations, 'Audited')) SELECT * FROM v",
    "change_components": _C + ", " + _CHANGE + " SELECT * FROM cmp",
    "change_summary": _C + ", " + _CHANGE + ", sm AS (SELECT change_id, " + ", ".join(f"count(*) FILTER (component = '{n}') AS n_{n}" for n in ("direct", "caller", "dependent", "endpoint", "module", "policy", "test")) + ", count(DISTINCT CASE WHEN component IN ('direct', 'caller', 'dependent') THEN key END) AS n_affected, count(*) FILTER (component = 'policy' AND starts_with(detail, 'error')) AS n_err FROM cmp GROUP BY change_id) SELECT * EXCLUDE (n_err), round(least(1.0, least(n_affected / 50.0, 0.4) + least(n_module / 5.0, 0.2) + least(n_endpoint / 10.0, 0.2) + least(n_err / 3.0, 0.2)), 4) AS risk FROM sm",
    "supertypes_resolved": _C + f", u AS (SELECT repo_id, name, min(fqn) AS target FROM cls GROUP BY repo_id, name HAVING count(DISTINCT fqn) = 1), f1 AS (SELECT r.repo_id, r.source, u.target FROM {_NAMED} r JOIN u USING (repo_id, name) WHERE r.source <> u.target), f2 AS (SELECT DISTINCT r.repo_id, r.source, i.target FROM {_NAMED} r JOIN cls c USING (repo_id, name) JOIN {_IMPORTS} i ON i.source = r.source AND i.target = c.fqn WHERE r.source NOT IN (SELECT source FROM f1)) SELECT *, 1 AS step FROM f1 UNION ALL SELECT *, 2 FROM f2",
    "calls_resolved": _C + ", raw AS (SELECT DISTINCT repo_id, caller, split_part(caller, '#', 1) AS cf, split_part(callee, '#', 2) AS name FROM call), f1 AS (SELECT DISTINCT r.repo_id, caller, m.fqn AS callee FROM raw r JOIN mth m ON m.class_fqn = cf AND m.name = r.name WHERE caller <> m.fqn), pk AS (SELECT c.repo_id, package_fqn, m.name, min(m.fqn) AS callee FROM mth m JOIN cls c ON c.fqn = m.class_fqn WHERE m.name NOT IN ('get', 'set', 'of', 'build', 'toString', 'equals', 'hashCode', 'main') GROUP BY ALL HAVING count(DISTINCT m.fqn) = 1), f2 AS (SELECT DISTINCT r.repo_id, caller, callee FROM raw r JOIN cls c ON c.fqn = r.cf JOIN pk ON pk.repo_id = r.repo_id AND pk.package_fqn = c.package_fqn AND pk.name = r.name WHERE caller NOT IN (SELECT caller FROM f1) AND caller <> callee) SELECT *, 1 AS step FROM f1 UNION ALL SELECT *, 2 FROM f2",
    "tests_by_name": _C + " SELECT c.repo_id, c.fqn, count(DISTINCT t.fqn) AS n_tests, min(t.fqn) AS first_test FROM cls c JOIN cls t ON t.repo_id = c.repo_id AND contains(t.name, c.name) WHERE NOT regexp_matches(c.name, '(Test|Spec)$') AND regexp_matches(t.name, '(Test|Spec)$') GROUP BY ALL",
    "field_types_resolved": _C + " SELECT repo_id, class_fqn, field, name, target FROM (SELECT f.repo_id, f.class_fqn, f.field, f.name, c.fqn AS target, row_number() OVER (PARTITION BY f.class_fqn, f.field, f.name ORDER BY c.module <> o.module, c.fqn) AS k FROM (SELECT DISTINCT repo_id, class_fqn, name AS field, trim(regexp_replace(type_name, '^List<|>$', '', 'g')) AS name FROM fld) f JOIN cls o ON o.fqn = f.class_fqn JOIN cls c ON c.repo_id = f.repo_id AND c.name = f.name) WHERE k = 1",
    "path_parameters": _C + " SELECT fqn, verb, array_to_string(regexp_extract_all(path, '\\{(\\w+)(?::[^}]*)?\\}', 1), ',') AS parameters, len(regexp_extract_all(path, '\\{(\\w+)(?::[^}]*)?\\}', 1)) AS n, regexp_replace(path, '\\{(\\w+)(?::[^}]*)?\\}', '{}', 'g') AS shape FROM endpoint",
}
_GOD = "SELECT c.repo_id, 'god_class-' || c.repo_id AS pattern_id, c.fqn FROM cls c JOIN (SELECT class_fqn, count(*) AS n FROM mth GROUP BY 1) m ON m.class_fqn = c.fqn JOIN (SELECT class_fqn, count(DISTINCT name) AS n FROM fld GROUP BY 1) f ON f.class_fqn = c.fqn WHERE m.n > {0} AND f.n > {1}"
SQL |= {
    "patterns_replaced": _C + f" SELECT repo_id, CASE WHEN repo_id = 'r2' OR repo_id NOT IN (SELECT repo_id FROM ({_GOD.format(34, 4)})) THEN 'first' ELSE 'second' END AS found_by, count(*) AS n FROM (SELECT repo_id, fqn FROM ({_GOD.format(30, 3)}) WHERE repo_id = 'r2' OR repo_id NOT IN (SELECT repo_id FROM ({_GOD.format(34, 4)})) UNION ALL SELECT repo_id, fqn FROM ({_GOD.format(34, 4)}) WHERE repo_id <> 'r2') GROUP BY ALL",
    "pattern_catalogue": _C + f", g AS ({_GOD.format(30, 3)}) SELECT t.id, t.title, pattern_id, coalesce(n, 0) AS n, samples FROM (VALUES ('god_class', 'God class'), ('factory', 'Factory')) t(id, title) LEFT JOIN (SELECT split_part(pattern_id, '-', 1) AS id, pattern_id, count(*) AS n, array_to_string(list_sort(list(fqn))[1:3], ',') AS samples FROM g GROUP BY ALL) x USING (id)",
    "insights_aged": _C + f", ch AS (SELECT DISTINCT file_path FROM cls WHERE {_OLD}), ins AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN fqn ELSE file_path END AS applies_to, c_custkey % 6 / 5.0 AS st FROM customer LEFT JOIN cls ON cls.k = c_custkey) SELECT k, round(CASE WHEN applies_to IN (SELECT file_path FROM ch) OR applies_to IN (SELECT fqn FROM cls JOIN ch USING (file_path)) THEN least(1.0, st + 0.2) ELSE st END, 4) AS staleness FROM ins",
    "insight_links": _C + " SELECT repo_id, count(*) AS n FROM customer JOIN cls ON cls.k = c_custkey WHERE c_custkey % 2 = 0 GROUP BY repo_id",
    "policy_targets": _C + " SELECT policy_id, module, severity, policy_id IN (SELECT policy_id FROM violate) AS is_violated FROM policy WHERE status = 'active' AND module IN (SELECT module FROM cls)",
    "module_pairs": _C + " SELECT e.repo_id, a.module AS a, b.module AS b, count(*) AS weight FROM edge e JOIN cls a ON a.fqn = e.source JOIN cls b ON b.fqn = e.target WHERE type = 'IMPORTS' AND a.module <> b.module GROUP BY ALL HAVING count(*) > 1",
    "enriched_list": _C + " SELECT x.at_ AS at, x.f AS fqn, kind, module FROM (SELECT 0 AS at_, fqn AS f FROM violate UNION ALL SELECT 1, fqn FROM violate UNION ALL SELECT 2, fqn || 'X' FROM violate) x LEFT JOIN cls ON cls.fqn = x.f",
    "changed_with_importers": _C + f" SELECT c.repo_id, c.file_path, array_to_string(list_concat(list_sort(list(DISTINCT c.fqn)), coalesce(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), [])), ',') AS affected, count(DISTINCT c.fqn) + count(DISTINCT source) AS n FROM cls c LEFT JOIN {_IMPORTS} i ON i.target = c.fqn WHERE c.file_path IN (SELECT file_path FROM cls WHERE {_OLD}) GROUP BY c.repo_id, c.file_path",
    "packages_by_relation": _C + f", m AS (SELECT DISTINCT s.package_fqn, e.source, e.type FROM edge e JOIN cls s ON s.fqn = e.source JOIN cls t ON t.fqn = e.target WHERE {_OLD.replace('annotations', 't.annotations')}) SELECT package_fqn, count(DISTINCT source) AS n, array_to_string(list_sort(list(DISTINCT type)), ',') AS relations, array_to_string(list_sort(list(DISTINCT source))[1:5], ',') AS classes FROM m GROUP BY package_fqn ORDER BY n DESC, package_fqn LIMIT 20",
    "edge_upsert": _C + " SELECT repo_id, type, count(*) AS n FROM (SELECT repo_id, type, source, target FROM edge UNION SELECT repo_id, 'USES', split_part(caller, '#', 1), split_part(callee, '#', 1) FROM call) GROUP BY ALL",
    "annotations_appended": _C + " SELECT c.fqn, array_to_string(list_append(coalesce(c.annotations, []), t.name), ',') AS annotations FROM edge e JOIN cls c ON c.fqn = e.source JOIN cls t ON t.fqn = e.target WHERE type = 'IMPLEMENTS'",
    "text_search": _C + " SELECT repo_id, kind, count(*) AS n FROM cls WHERE contains(lower(name), 'ring') OR contains(lower(package_fqn), 'ring') OR contains(lower(coalesce(javadoc, '')), 'ring') GROUP BY ALL",
    "entry_points": _C + " SELECT repo_id, regexp_matches(file_path, '\\.(js|ts)$') AS script, count(*) AS n, min(fqn) AS first FROM cls WHERE CASE WHEN regexp_matches(file_path, '\\.(js|ts)$') THEN regexp_matches(name, '(Controller|Client|Job)$') ELSE regexp_matches(name, '(Controller|Handler)$') END GROUP BY ALL",
    "class_pages": _C + ", x AS (SELECT fqn, (SELECT count(*) FROM mth m WHERE m.class_fqn = c.fqn) AS n_methods FROM cls c WHERE kind IN ('class', 'enum') AND contains(lower(name), 'ring')) SELECT *, (SELECT count(*) FROM x) AS total, (SELECT CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) FROM x) AS pages FROM x ORDER BY n_methods DESC, fqn LIMIT 10",
    "hygiene_scores": _C + _FAN + " SELECT repo_id, fqn, n_methods, fan_in, fan_out, blast_size, size_score, blast_score, coupling_score, docs_score, score, grade, tier, n_warnings FROM sc",
    "hygiene_scores_repo": _C + _FAN + ", r AS (SELECT repo_id, count(*) AS n_classes, count(*) FILTER (NOT is_test) AS n_scored, count(*) FILTER (tier = 'god') AS n_god, sum(score) FILTER (NOT is_test) AS s, sum(tok) FILTER (NOT is_test) AS tokens, " + ", ".join(f"count(*) FILTER (NOT is_test AND grade = '{g}') AS n_{g.lower()}" for g in "ABCDF") + " FROM sc GROUP BY repo_id), q AS (SELECT *, least(20, 2 * greatest(0, n_god - greatest(1, round_even(n_classes * 0.01, 0)))) AS penalty FROM r), z AS (SELECT *, round_even(greatest(0.0, s / greatest(n_scored, 1) - penalty), 1) AS score FROM q) SELECT repo_id, n_classes, n_scored, n_god, CAST(penalty AS BIGINT) AS penalty, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade, n_a, n_b, n_c, n_d, n_f, CAST(tokens AS BIGINT) AS tokens FROM z",
}
_REASONS = (("tier = 'god'", "0", "god_class"), ("tier = 'large'", "1", "large_class"), ("coupling > 0.35", "CASE WHEN coupling > 0.6 THEN 0 ELSE 1 END", "high_coupling"), ("blast_size > 50", "0", "high_blast"), ("blast_size > 20 AND blast_size <= 50", "1", "medium_blast"), ("doc = 0", "1", "missing_docs"), ("n_methods > 20 AND tier <> 'god'", "2", "too_many_methods"))
_LISTED = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} THEN CAST(({r}) AS VARCHAR) || '{k}' || ['high', 'medium', 'low'][({r}) + 1] || ':{name}' END" for k, (t, r, name) in enumerate(_REASONS)) + "], lambda x: x IS NOT NULL))"
SQL["refactor_reasons"] = _C + _FAN + f" SELECT fqn, tier, array_to_string(list_transform({_LISTED}, lambda x: x[3:]), ',') AS reasons FROM sc WHERE len({_LISTED}) > 0"
