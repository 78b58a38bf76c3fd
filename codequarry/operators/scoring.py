"""Roles, scores and patterns of classes as column expressions over tables of rules.

Each rule set is data: suffixes, markers and thresholds. One function compiles it to a Spark column, another to the text of an
SQL expression, so that both engines evaluate the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators import closure

# Roles in the order in which they are tried, with the suffixes of names, annotations, path parts and kinds that
# make them.
ROLE_SUFFIXES = {
    "TEST": ("Test", "Tests", "IT", "TestCase", "Spec"),
    "CONFIGURATION": ("Config", "Configuration", "Settings", "Properties", "AutoConfiguration"),
    "COMMAND": ("Action", "Command", "Handler", "Request", "Response", "Event", "Message", "Task"),
    "SERVICE": ("Service", "Manager", "Coordinator", "Orchestrator", "Controller", "Processor", "Dispatcher"),
    "REPOSITORY": ("Repository", "Dao", "Store", "Provider", "Persister", "Client", "Gateway", "Adapter"),
    "FACTORY": ("Factory", "Builder", "Creator", "Producer", "Assembler"),
    "VALUE_OBJECT": ("DTO", "Dto", "Payload", "Model", "Record", "Entity", "Document", "Info", "Data", "Result"),
    "UTILITY": ("Util", "Utils", "Helper", "Helpers", "Constants", "Strings", "Comparators", "Validators"),
}
ROLE_ANNOTATIONS = {
    "CONFIGURATION": ("Configuration", "ConfigurationProperties", "EnableAutoConfiguration", "SpringBootApplication"),
    "SERVICE": ("Service", "Component"),
    "REPOSITORY": ("Repository",),
}
TEST_PARTS = ("test", "tests", "it", "integration-test", "test-framework", "yaml-rest-runner", "test-clusters")
GENERATED_MARKS = ("/generated/", "/generated-src/", "Generated", "generated-sources")
VALUE_KINDS = ("enum", "interface", "annotation")


def _suffix(role: str) -> str:
    return f"({'|'.join(ROLE_SUFFIXES[role])})$"


def role(name: Column, path: Column, annotations: Column, kind: Column, has_fields: Column) -> Column:
    """The first role whose rule holds, else CLASS. Null paths, annotations and kinds match no rule."""
    marked = F.array_join(F.transform(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: F.concat(F.lit("@"), F.ltrim(F.regexp_replace(a, "^@", "")))), " ")
    by_annotation = lambda r: marked.rlike(r"@(" + "|".join(ROLE_ANNOTATIONS[r]) + r")\b")
    ends = lambda r: name.rlike(_suffix(r))
    abstract = F.coalesce(kind, F.lit("")).isin("abstract", "abstract_class")
    return (
        F.when(ends("TEST") | path.rlike(f"(^|/)({'|'.join(TEST_PARTS)})/"), "TEST")
        .when(path.rlike("|".join(GENERATED_MARKS)), "GENERATED")
        .when(by_annotation("CONFIGURATION") | ends("CONFIGURATION"), "CONFIGURATION")
        .when(name.rlike("^Transport.*(Action|Task)"), "TRANSPORT")
        .when(ends("COMMAND"), "COMMAND")
        .when(by_annotation("SERVICE") | ends("SERVICE"), "SERVICE")
        .when(by_annotation("REPOSITORY") | ends("REPOSITORY"), "REPOSITORY")
        .when(ends("FACTORY"), "FACTORY")
        .when(F.coalesce(kind, F.lit("")).isin(*VALUE_KINDS) | ends("VALUE_OBJECT"), "VALUE_OBJECT")
        .when(ends("UTILITY") | abstract & ~has_fields, "UTILITY")
        .when(abstract, "ABSTRACT_BASE")
        .otherwise("CLASS")
    )


def with_role(cls: DataFrame, fld: DataFrame) -> DataFrame:
    """``cls`` with its role. Classes without a kind column count as plain ones."""
    kind = F.col("kind") if "kind" in cls.columns else F.lit(None).cast("string")
    with_fields = fld.select("repo_id", F.col("class_fqn").alias("fqn"), F.lit(True).alias("_fields")).distinct()
    return cls.join(with_fields, ["repo_id", "fqn"], "left").withColumn("role", role(F.col("name"), F.col("file_path"), F.col("annotations"), kind, F.coalesce("_fields", F.lit(False)))).drop("_fields")


def _sql_ends(r: str) -> str:
    return f"regexp_matches(name, '{_suffix(r)}')"


ROLE_SQL = f"""CASE WHEN {_sql_ends("TEST")} OR regexp_matches(file_path, '(^|/)({"|".join(TEST_PARTS)})/') THEN 'TEST'
    WHEN regexp_matches(file_path, '{"|".join(GENERATED_MARKS)}') THEN 'GENERATED' WHEN {_sql_ends("CONFIGURATION")} THEN 'CONFIGURATION'
    WHEN regexp_matches(name, '^Transport.*(Action|Task)') THEN 'TRANSPORT' WHEN {_sql_ends("COMMAND")} THEN 'COMMAND' WHEN {_sql_ends("SERVICE")} THEN 'SERVICE'
    WHEN {_sql_ends("REPOSITORY")} THEN 'REPOSITORY' WHEN {_sql_ends("FACTORY")} THEN 'FACTORY' WHEN {_sql_ends("VALUE_OBJECT")} THEN 'VALUE_OBJECT'
    WHEN {_sql_ends("UTILITY")} THEN 'UTILITY' ELSE 'CLASS' END"""

# Steps of scores, each up to its limit; the last holds beyond.
SIZE_STEPS = ((10, 25), (20, 18), (30, 10), (60, 4), (None, 0))
BLAST_STEPS = ((0, 25), (5, 20), (20, 12), (50, 5), (100, 2), (None, 0))
COUPLING_STEPS = ((0.10, 25), (0.20, 20), (0.35, 12), (0.50, 6), (None, 0))
# Least scores of grades; least methods and blast sizes of tiers; score of documentation; share of god classes that
# costs nothing, what each further one costs and the most that they cost.
GRADES = ((80, "A"), (65, "B"), (50, "C"), (35, "D"), (None, "F"))
TIERS = ((60, 100, "god"), (30, 50, "large"), (15, None, "medium"), (5, None, "small"))
DOCS_SCORE = 25
GOD_ALLOWED, GOD_COST, GOD_MOST = 0.01, 2, 20


def steps(value: Column, table: tuple, below: bool = False) -> Column:
    """The score of the first step that holds the value: up to its limit, or below it."""
    out = None
    for limit, score in table:
        if limit is None:
            return out.otherwise(F.lit(score))
        test = value < limit if below else value <= limit
        out = F.when(test, F.lit(score)) if out is None else out.when(test, F.lit(score))
    return out


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for limit, name in GRADES[1:-1]:
        out = out.when(score >= limit, name)
    return out.otherwise(GRADES[-1][1])


def tier(n_methods: Column, blast: Column) -> Column:
    out = None
    for methods, reach, name in TIERS:
        test = n_methods > methods if reach is None else (n_methods > methods) | (blast > reach)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("tiny")


def coupling(fan_in: Column, fan_out: Column, n_methods: Column, most_in: Column, most_out: Column) -> Column:
    """Half the share of the greatest fan-in, a quarter each of the greatest fan-out and of 50 methods; 4 decimals, 1 at most."""
    raw = 0.5 * fan_in / F.greatest(most_in, F.lit(1)) + 0.25 * fan_out / F.greatest(most_out, F.lit(1)) + 0.25 * F.least(n_methods / 50, F.lit(1.0))
    return F.when((most_in == 0) & (most_out == 0), F.lit(0.0)).otherwise(F.bround(F.least(raw, F.lit(1.0)), 4))


def impact_risk(n: Column, modules: Column, endpoints: Column, error_policies: Column) -> Column:
    """The risk of a change by affected classes, modules, endpoints and policies of severity error; 1 at most."""
    return F.least(F.lit(1.0), F.least(n / 50, F.lit(0.4)) + F.least(modules / 5, F.lit(0.2)) + F.least(endpoints / 10, F.lit(0.2)) + F.least(error_policies / 3, F.lit(0.2)))


def god_classes(cls: DataFrame, mth: DataFrame, fld: DataFrame, methods: int = 30, fields: int = 20) -> DataFrame:
    """(repo_id, fqn, n_methods, n_fields): classes, inner ones aside, with more methods and more fields than the bounds.

    Both are counted apart before they meet, so no product of them arises. Methods count as declared, fields by name.
    """
    m = mth.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n_methods")).where(F.col("n_methods") > methods)
    f = fld.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.countDistinct("name").alias("n_fields")).where(F.col("n_fields") > fields)
    return cls.where(~F.col("fqn").contains("$")).select("repo_id", "fqn").distinct().join(m, ["repo_id", "fqn"]).join(f, ["repo_id", "fqn"])


# The least coupling and blast size that are warned of; weights of tiers; tokens of a task on a clean class and how
# many times as many a score costs; what summaries make of documentation.
WARN_COUPLING, WARN_BLAST = 0.7, 20
TIER_WEIGHTS = {"god": 10.0, "large": 4.0, "medium": 2.0, "small": 1.0, "tiny": 0.5}
BASE_TOKENS, COSTS = 500, ((80, 1.0), (60, 1.8), (40, 3.5), (20, 7.0), (None, 15.0))
SKIPPED_ROLES = ("TEST", "GENERATED")
RANKS = ("high", "medium", "low")


def _tokens(score: Column) -> Column:
    out = F.when(score >= COSTS[0][0], COSTS[0][1])
    for limit, times in COSTS[1:-1]:
        out = out.when(score >= limit, times)
    return F.bround(BASE_TOKENS * out.otherwise(COSTS[-1][1])).cast("long")


def enriched(cls: DataFrame, mth: DataFrame, fld: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, fqn, name, role, documented, summarised, n_methods, fan_in, fan_out, coupling, blast_size, warnings of each class.

    edges: repo_id, source, target, as from ``graph.class_edges``. Fan-in and fan-out are held against the greatest of the
    repository, 1 where it has no edges; the blast size counts all that depend on a class, however far, 500 standing for more. Of a class that came
    several times the first path's role counts.
    """
    summary = F.col("summary").isNotNull() if "summary" in cls.columns else F.lit(False)
    roles = with_role(cls, fld).groupBy("repo_id", "fqn").agg(F.min("name").alias("name"), F.min(F.struct("file_path", "role"))["role"].alias("role"), F.max(F.col("javadoc").isNotNull()).alias("documented"), F.max(summary).alias("summarised"))
    key = lambda c: F.struct("repo_id", F.col(c).alias("fqn"))
    blast = closure.blast_sizes(edges.select(key("source").alias("src"), key("target").alias("dst"))).select("node.repo_id", "node.fqn", F.col("size").alias("blast_size"))
    n = mth.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("n_methods"))
    into, out = edges.groupBy("repo_id", F.col("target").alias("fqn")).agg(F.count("*").alias("fan_in")), edges.groupBy("repo_id", F.col("source").alias("fqn")).agg(F.count("*").alias("fan_out"))
    most = into.groupBy("repo_id").agg(F.max("fan_in").alias("most_in")).join(out.groupBy("repo_id").agg(F.max("fan_out").alias("most_out")), "repo_id", "full_outer")
    got = roles
    for other in (n, into, out, blast):
        got = got.join(other, ["repo_id", "fqn"], "left")
    got = got.join(most, "repo_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_methods", "fan_in", "fan_out", "blast_size")}).withColumns({c: F.coalesce(c, F.lit(1)) for c in ("most_in", "most_out")})
    got = got.withColumn("coupling", coupling(F.col("fan_in"), F.col("fan_out"), F.col("n_methods"), F.col("most_in"), F.col("most_out")))
    tight = F.when(F.col("coupling") >= WARN_COUPLING, F.format_string("High coupling (%.2f) — %d transitive dependents", "coupling", "blast_size"))
    wide = F.when(F.col("blast_size") > WARN_BLAST, F.format_string("Large blast radius — %d classes affected by signature changes", "blast_size"))
    return got.select("repo_id", "fqn", "name", "role", "documented", "summarised", "n_methods", "fan_in", "fan_out", "coupling", "blast_size", F.array_compact(F.array(tight, wide)).alias("warnings"))


def _reasons() -> Column:
    """(rank, place, id) of the reasons that hold, by rank and place."""
    c, b, t = F.col("coupling"), F.col("blast_size"), F.col("tier")
    found = (
        ("god_class", t == "god", F.lit(0)), ("large_class", t == "large", F.lit(1)), ("high_coupling", c > 0.35, F.when(c > 0.6, 0).otherwise(1)), ("high_blast", b > 50, F.lit(0)), ("medium_blast", (b > 20) & (b <= 50), F.lit(1)),
        ("missing_docs", ~F.col("documented"), F.lit(1)), ("too_many_methods", (F.col("n_methods") > 20) & (t != "god"), F.lit(2)),
    )
    return F.sort_array(F.array_compact(F.array(*[F.when(test, F.struct(rank.alias("rank"), F.lit(k).alias("place"), F.lit(name).alias("id"))) for k, (name, test, rank) in enumerate(found)])))


def whole_scores(own: DataFrame) -> DataFrame:
    """``enriched`` classes with the scores of all four dimensions, their sum, grade, tier, reasons to refactor and the benefit."""
    d = F.col("documented")
    got = own.withColumns({"size_score": steps(F.col("n_methods"), SIZE_STEPS), "blast_score": steps(F.col("blast_size"), BLAST_STEPS), "coupling_score": steps(F.col("coupling"), COUPLING_STEPS, below=True), "docs_score": F.when(d, DOCS_SCORE).otherwise(0)})
    got = got.withColumn("assisted_docs_score", F.when(d & F.col("summarised"), 25).when(d, 20).when(F.col("summarised"), 18).otherwise(0))
    got = got.withColumn("score", F.col("size_score") + F.col("blast_score") + F.col("coupling_score") + F.col("docs_score"))
    got = got.withColumn("grade", grade(F.col("score"))).withColumn("tier", tier(F.col("n_methods"), F.col("blast_size"))).withColumn("_reasons", _reasons())
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair]), F.col("tier"))
    high = F.size(F.filter("_reasons", lambda x: x["rank"] == 0))
    got = got.withColumn("benefit", F.bround((100 - F.col("score")) * weight * (1 + F.col("blast_size") * 0.05) * (1 + high * 0.3), 1))
    return got.withColumn("reasons", F.transform("_reasons", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, RANKS)), x["rank"] + 1), x["id"]))).drop("_reasons")


def whole_repo_scores(scored: DataFrame) -> DataFrame:
    """One row per repository: the mean score of classes that are no tests and not generated, less what gods beyond 1 % of all cost.

    With it the grade, grades' numbers and tokens, what lifting C, D and F to B and what a full cleanup would save, the dimensions
    by lost points (dims), and the score that summaries would give. Rounding is half-even.
    """
    own = ~F.col("role").isin(*SKIPPED_ROLES)
    token = _tokens(F.col("score"))
    at = lambda test, v: F.coalesce(F.sum(F.when(own & test, v)), F.lit(0))
    low = F.col("grade").isin("C", "D", "F")
    dims = (("Documentation", "docs_score", ~F.col("documented") & ~F.col("summarised"), ~F.col("documented")), ("Class size", "size_score", F.col("size_score") < 25, F.col("n_methods") > 15), ("Blast radius", "blast_score", F.col("blast_score") < 25, F.col("blast_size") > 5), ("Coupling", "coupling_score", F.col("coupling_score") < 25, F.col("coupling") >= 0.2))
    any_ = F.lit(True)
    total = scored.groupBy("repo_id").agg(
        F.count("*").alias("n_classes"), F.count_if(own).alias("n_scored"), F.count_if(F.col("tier") == "god").alias("n_god"), at(any_, F.col("score")).alias("sum"), at(any_, F.col("assisted_docs_score")).alias("assisted_sum"), *[F.count_if(own & (F.col("grade") == g)).alias(f"n_{g.lower()}") for _, g in GRADES],
        at(any_, token).alias("tokens"), at(low, token).alias("low_tokens"), F.count_if(own & low).alias("n_low"), *[x for k, (_, c, fails, affected) in enumerate(dims) for x in (at(any_, F.col(c)).alias(f"sum{k}"), F.count_if(own & fails).alias(f"fails{k}"), F.count_if(own & affected).alias(f"affected{k}"))],
    )
    n = F.greatest(F.col("n_scored"), F.lit(1))
    penalty = F.least(F.lit(GOD_MOST), GOD_COST * F.greatest(F.lit(0), F.col("n_god") - F.greatest(F.lit(1), F.bround(F.col("n_classes") * GOD_ALLOWED).cast("long"))))
    average = [F.bround(F.col(f"sum{k}") / n, 1) for k in range(len(dims))]
    rows = [F.struct((-F.bround(25 - average[k], 1)).alias("minus"), F.lit(k).alias("place"), F.lit(dims[k][0]).alias("name"), average[k].alias("avg"), F.bround(F.col(f"fails{k}") / n * 100, 1).alias("fail_pct"), F.col(f"affected{k}").alias("affected")) for k in range(len(dims))]
    ranked = F.transform(F.sort_array(F.array(*rows)), lambda x: F.struct(x["name"].alias("name"), x["avg"].alias("avg"), (-x["minus"]).alias("lost"), x["fail_pct"].alias("fail_pct"), x["affected"].alias("affected")))
    final = lambda raw: F.bround(F.greatest(F.lit(0.0), raw - F.col("penalty")), 1)
    share = lambda saved: F.bround(saved / F.greatest(F.col("tokens"), F.lit(1)) * 100, 1)
    got = total.withColumn("penalty", penalty).withColumn("score", final(F.col("sum") / n)).withColumn("assisted_score", final(average[1] + average[2] + average[3] + F.bround(F.col("assisted_sum") / n, 1)))
    got = got.withColumn("saving_to_b", F.greatest(F.lit(0), F.col("low_tokens") - F.col("n_low") * _tokens(F.lit(65)))).withColumn("saving_full", F.greatest(F.lit(0), F.col("tokens") - F.col("n_scored") * BASE_TOKENS))
    return got.select(
        "repo_id", "n_classes", "n_scored", "n_god", "penalty", "score", grade(F.col("score")).alias("grade"), *[f"n_{g.lower()}" for _, g in GRADES], "tokens", "saving_to_b", share(F.col("saving_to_b")).alias("saving_to_b_pct"), "saving_full", share(F.col("saving_full")).alias("saving_full_pct"),
        ranked.alias("dims"), "assisted_score", grade(F.col("assisted_score")).alias("assisted_grade"),
    )


# Patterns: our own catalogue, by signals of names, annotations and paths.
CATALOGUE = {
    "factory": {"name_suffix": ("Factory", "Builder")},
    "repository": {"name_suffix": ("Repository", "Store"), "annotation_contains": ("Repository",)},
    "scheduler": {"name_suffix": ("Scheduler", "Job"), "annotation_contains": ("Scheduled",)},
    "registry": {"name_suffix": ("Registry",)},
    "adapter": {"name_suffix": ("Adapter", "Mapper"), "name_prefix": ("Adapting",)},
    "generated_code": {"path_contains": ("/generated/", "/autogen/", "/src-gen/")},
}


def patterns(cls: DataFrame, catalogue: dict = CATALOGUE) -> DataFrame:
    """(pattern_id, repo_id, fqn, signals): classes of each pattern with the sorted names of the signals that hit.

    The catalogue compiles to one array of hits per class, which is exploded; inner classes ($) are left out.
    """
    tests = {"name_suffix": lambda v: F.col("name").endswith(v), "name_prefix": lambda v: F.col("name").startswith(v), "path_contains": lambda v: F.col("file_path").contains(v), "annotation_contains": lambda v: F.exists("annotations", lambda a: a.contains(v))}
    hits = []
    for pattern, signals in catalogue.items():
        for signal, values in signals.items():
            test = F.lit(False)
            for v in values:
                test = test | tests[signal](v)
            hits.append(F.when(test, F.struct(F.lit(pattern).alias("pattern_id"), F.lit(signal).alias("signal"))))
    found = cls.where(~F.col("fqn").contains("$")).select("repo_id", "fqn", F.explode(F.array_compact(F.array(*hits))).alias("x"))
    return found.groupBy("x.pattern_id", "repo_id", "fqn").agg(F.array_join(F.sort_array(F.collect_set("x.signal")), ",").alias("signals"))


def _signal_sql(signal: str, values: tuple) -> str:
    one = {"name_suffix": "suffix(name, '{}')", "name_prefix": "starts_with(name, '{}')", "path_contains": "contains(file_path, '{}')", "annotation_contains": "len(list_filter(annotations, lambda a: contains(a, '{}'))) > 0"}[signal]
    return " OR ".join(one.format(v) for v in values)


PATTERNS_SQL = "hits AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pattern_id, repo_id, fqn, '{s}' AS signal FROM cls WHERE {_signal_sql(s, v)}" for p, signals in CATALOGUE.items() for s, v in signals.items()) + "), pat AS (SELECT pattern_id, repo_id, fqn, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM hits WHERE NOT contains(fqn, '$') GROUP BY ALL)"


#: Signals of a catalogue that are lists of words, and those that are bounds.
WORD_SIGNALS = ("name_suffix", "name_prefix", "base_class_contains", "annotation_contains", "method_name_contains", "generated_path")
BOUND_SIGNALS = ("method_count_gt", "field_count_gt")


def detected_patterns(cls: DataFrame, mth: DataFrame, fld: DataFrame, edges: DataFrame, languages: DataFrame, catalogue: dict[str, dict]) -> DataFrame:
    """(repo_id, pattern_id, fqn, signals): classes of each pattern of a catalogue, with the names of the signals that hit.

    catalogue: by pattern its signals and, as ``language``, the one that it is for (any without). A list hits with any of its words;
    ``generated_path`` counts only with a hit of ``name_suffix`` where the pattern has both; the bounds of methods and fields hit
    together. languages: repo_id, language. edges: repo_id, type, source, target. Inner classes ($) are left out.
    """
    base = edges.where("type in ('EXTENDS', 'IMPLEMENTS')").select("repo_id", F.col("source").alias("fqn"), F.substring_index("target", ".", -1).alias("base")).groupBy("repo_id", "fqn").agg(F.collect_set("base").alias("bases"))
    m = mth.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.collect_set("name").alias("methods"), F.count("*").alias("n_methods"))
    f = fld.groupBy("repo_id", F.col("class_fqn").alias("fqn")).agg(F.countDistinct("name").alias("n_fields"))
    own = cls.where(~F.col("fqn").contains("$")).select("repo_id", "fqn", "name", "file_path", "annotations").join(base, ["repo_id", "fqn"], "left").join(m, ["repo_id", "fqn"], "left").join(f, ["repo_id", "fqn"], "left").join(languages, "repo_id", "left")
    within = lambda c, v: F.coalesce(F.exists(c, lambda x: x.contains(v)), F.lit(False))
    word = {
        "name_suffix": lambda v: F.col("name").endswith(v), "name_prefix": lambda v: F.col("name").startswith(v), "generated_path": lambda v: F.col("file_path").contains(v),
        "base_class_contains": lambda v: within("bases", v), "annotation_contains": lambda v: within("annotations", v), "method_name_contains": lambda v: within("methods", v),
    }
    counts = {"method_count_gt": F.coalesce("n_methods", F.lit(0)), "field_count_gt": F.coalesce("n_fields", F.lit(0))}
    hits = []
    for pattern, signals in catalogue.items():
        here = F.lit(True) if signals.get("language", "any") == "any" else F.coalesce(F.col("language") == signals["language"], F.lit(False))
        test = {}
        for s in (s for s in WORD_SIGNALS if s in signals):
            test[s] = F.lit(False)
            for v in signals[s]:
                test[s] = test[s] | word[s](v)
        if "generated_path" in test and "name_suffix" in test:
            both = test.pop("generated_path") & test.pop("name_suffix")
            test["generated_path"] = both
        bounds = [counts[s] > signals[s] for s in BOUND_SIGNALS if s in signals]
        if bounds:
            test["counts"] = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
        hits += [F.when(here & t, F.struct(F.lit(pattern).alias("pattern_id"), F.lit(s).alias("signal"))) for s, t in test.items()]
    found = own.select("repo_id", "fqn", F.explode(F.array_compact(F.array(*hits))).alias("x"))
    return found.groupBy("repo_id", "x.pattern_id", "fqn").agg(F.array_join(F.sort_array(F.collect_set("x.signal")), ",").alias("signals"))
