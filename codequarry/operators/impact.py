"""What a change touches: classes of its files, callers, dependents, endpoints, modules, policies and tests, and the risk of it.

Many changes are answered at once: every step keeps the change's id beside its rows, so one plan serves a commit as well as a
history. Nothing is capped; a caller that lists results takes the first by hops and name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.detectors import CodeGraph
from codequarry.operators.scoring import impact_risk
from codequarry.tables import cut, release

# Confidence of each way to be touched, hops of dependents, names that end tests.
CONFIDENCE = {"direct": 0.85, "caller": 0.80, "dependent": 0.75, "endpoint": 0.90}
HOPS = 4
TEST_SUFFIXES = ("Test", "Tests", "Spec")


@dataclass
class Surroundings:
    """endpoints: repo_id, fqn, verb, path; policies: policy_id, module, severity, status; violates: fqn, policy_id."""

    endpoints: DataFrame
    policies: DataFrame
    violates: DataFrame


def _hits(g: CodeGraph, direct: DataFrame) -> DataFrame:
    """(change_id, repo_id, fqn, hops, calls), written once: the changed classes, what imports them in at most ``HOPS`` steps and what calls them.

    hops are the least steps, 0 of the changed classes and null of what only calls; calls tells what calls a changed class. One
    aggregation makes all of these, so no part is held against another by a join.
    """
    back = g.edges.where("type = 'IMPORTS'").select("repo_id", F.col("target").alias("fqn"), F.col("source").alias("next"))
    levels = [direct]
    for _ in range(HOPS):  # each is read by the next hop and the union
        levels.append(cut(levels[-1].join(back, ["repo_id", "fqn"]).select("change_id", "repo_id", F.col("next").alias("fqn")).distinct()))
    owner = lambda c: F.substring_index(c, "#", 1)
    callers = direct.join(g.calls.select("repo_id", owner("callee").alias("fqn"), owner("caller").alias("caller")), ["repo_id", "fqn"]).select("change_id", "repo_id", F.col("caller").alias("fqn"))
    parts = [df.withColumns({"hops": F.lit(hops), "calls": F.lit(False)}) for hops, df in enumerate(levels)] + [callers.withColumns({"hops": F.lit(None).cast("int"), "calls": F.lit(True)})]
    found = cut(reduce(DataFrame.unionByName, parts).groupBy("change_id", "repo_id", "fqn").agg(F.min("hops").alias("hops"), F.max("calls").alias("calls")))
    release(*levels[1:])
    return found


def _tests(g: CodeGraph, direct: DataFrame, modules: DataFrame) -> DataFrame:
    """(change_id, repo_id, fqn, reason): tests whose name holds a changed class's, then those of touched modules.

    A test is found by all pieces of its name, so that no test is held against every class. Names that many tests bear are cut into
    pieces once.
    """
    ends = reduce(lambda a, b: a | b, (F.col("name").endswith(x) for x in TEST_SUFFIXES))
    test = g.cls.where(ends).select("repo_id", "fqn", "name", "module")
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda a: F.transform(F.sequence(F.lit(1), F.length("name") - a + 1), lambda n: F.substring("name", a, n)))))
    names = direct.select("change_id", "repo_id", F.substring_index("fqn", ".", -1).alias("piece")).distinct()
    held = test.select("repo_id", "name").distinct().select("repo_id", "name", F.explode(pieces).alias("piece")).join(names, ["repo_id", "piece"]).select("change_id", "repo_id", "name").distinct()
    by_name = test.join(held, ["repo_id", "name"]).select("change_id", "repo_id", "fqn", F.lit(0).alias("rank"))
    by_module = test.join(modules, ["repo_id", "module"]).select("change_id", "repo_id", "fqn", F.lit(1).alias("rank"))
    first = by_name.unionByName(by_module).groupBy("change_id", "repo_id", "fqn").agg(F.min("rank").alias("rank"))
    return first.select("change_id", "repo_id", "fqn", F.when(F.col("rank") == 0, "name-match").otherwise("same-module").alias("reason"))


def components(g: CodeGraph, around: Surroundings, changed: DataFrame) -> DataFrame:
    """(change_id, component, key, hops, confidence, detail): all that each change touches, each once.

    changed: change_id, repo_id, file_path. component is direct, caller, dependent, endpoint, module, policy or test; key its
    class, path, module or policy; detail the severity and state of a policy, the reason of a test. hops and confidence are null
    where they mean nothing. Changes of files without classes have no rows. The driver's memory follows the size of plans and of what
    runs at once, not the tables; so steps are written one after the other, and the last plan is little more than their union.
    """
    direct = cut(changed.select("change_id", "repo_id", "file_path").distinct().join(g.cls.select("repo_id", "file_path", "fqn"), ["repo_id", "file_path"]).select("change_id", "repo_id", "fqn").distinct())
    hits = _hits(g, direct)
    modules = cut(hits.join(g.cls.where("module is not null").select("repo_id", "fqn", "module"), ["repo_id", "fqn"]).select("change_id", "repo_id", "module").distinct())
    tests = cut(_tests(g, direct, modules))
    violated = around.violates.select("policy_id").distinct().withColumn("violated", F.lit(True))
    policies = modules.join(around.policies.where("status = 'active'"), "module").join(violated, "policy_id", "left").select("change_id", "policy_id", F.concat_ws(":", "severity", F.when(F.col("violated"), "violated").otherwise("kept")).alias("detail")).distinct()
    endpoints = direct.join(around.endpoints, ["repo_id", "fqn"]).select("change_id", F.concat_ws(" ", "verb", "path").alias("key")).distinct()

    def rows(df: DataFrame, component: str, key: str, hops=None, detail=None) -> DataFrame:
        confidence = F.lit(CONFIDENCE[component]) if component in CONFIDENCE else F.lit(None).cast("double")
        return df.select("change_id", F.lit(component).alias("component"), F.col(key).alias("key"), (F.lit(None) if hops is None else hops).cast("int").alias("hops"), confidence.alias("confidence"), (F.lit("") if detail is None else F.col(detail)).alias("detail"))

    parts = (
        rows(direct, "direct", "fqn", F.lit(0)), rows(hits.where("calls and (hops is null or hops > 0)"), "caller", "fqn", F.lit(1)), rows(hits.where("hops > 0"), "dependent", "fqn", F.col("hops")),
        rows(endpoints, "endpoint", "key"), rows(modules, "module", "module"), rows(policies, "policy", "policy_id", detail="detail"), rows(tests, "test", "fqn", detail="reason"),
    )
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    """(change_id, a count of each component, n_affected, risk) of ``components``: affected classes count once each."""
    names = ("direct", "caller", "dependent", "endpoint", "module", "policy", "test")
    affected = F.countDistinct(F.when(F.col("component").isin("direct", "caller", "dependent"), F.col("key")))
    got = found.groupBy("change_id").agg(*[F.count_if(F.col("component") == n).alias(f"n_{n}") for n in names], affected.alias("n_affected"), F.count_if((F.col("component") == "policy") & F.col("detail").startswith("error")).alias("_errors"))
    return got.withColumn("risk", F.bround(impact_risk(F.col("n_affected"), F.col("n_module"), F.col("n_endpoint"), F.col("_errors")), 4)).drop("_errors")
