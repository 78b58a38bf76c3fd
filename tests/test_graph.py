import random

from pyspark.sql import functions as F

from codequarry import graph
from codequarry.operators import closure, paths, scoring, signals
from codequarry.plans import activity


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_reach_with_cycles_and_diamonds(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(1, 1), (None, 2), (3, None), (1, 2), (2, 1)]
    out = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
    want = set()
    for s in out:
        seen, front, hop = {}, {s}, 0
        while front:
            hop += 1
            front = {y for x in front for y in out.get(x, ())} - set(seen) - {s}
            seen |= {x: hop for x in front}
        want |= {(s, x, h) for x, h in seen.items()}
    assert {tuple(r) for r in closure.reach(edges(spark, pairs)).collect()} == want
    sizes = {}
    for s, x, _ in want:
        sizes[x] = sizes.get(x, 0) + 1
    assert {(r["node"], r["size"]) for r in closure.blast_sizes(edges(spark, pairs)).collect()} == set(sizes.items())
    assert {(r["node"], r["size"]) for r in closure.blast_sizes(edges(spark, pairs), 5).collect()} == {(k, min(n, 5)) for k, n in sizes.items()}
    assert closure.blast_sizes(edges(spark, [])).count() == 0


def test_reach_empty(spark):
    assert closure.reach(edges(spark, [])).count() == 0


def test_bounded_and_depth(spark):
    chain = edges(spark, [(k + 1, k) for k in range(8)])
    assert {tuple(r) for r in closure.dependents(chain, spark.createDataFrame([(2,)], "node long"), 3).collect()} == {(3, 1), (4, 2), (5, 3)}
    assert {tuple(r) for r in closure.depth_to_root(chain).collect()} == {(k, k) for k in range(1, 9)}
    assert closure.depth_to_root(edges(spark, [(1, 2), (2, 1)]), 5).count() == 0
    assert [tuple(r) for r in closure.two_cycles(edges(spark, [(1, 2), (2, 1), (2, 3), (4, 4)])).collect()] == [(1, 2)]


def test_spine(spark):
    e = edges(spark, [(1, 2), (1, 3), (3, 4), (4, 1), (2, 5)])
    layer = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2), (5, 3)], "node long, layer int")
    got = closure.spine(e, spark.createDataFrame([(1,)], "node long"), layer).orderBy("hop").collect()
    assert [r["node"] for r in got] == [1, 3, 4]


def test_path_owners_go_by_whole_parts(spark):
    files = spark.createDataFrame([("r", "/a/b/x.py"), ("r", "/a/b2/y.py"), ("r", "/a/b/c/z.py"), ("q", "/a/b/x.py")], "repo_id string, file_path string")
    dirs = spark.createDataFrame([("r", "/a/b"), ("r", "/a/b/c"), ("r", "/a")], "repo_id string, path string")
    assert {tuple(r) for r in paths.longest_owner(files, dirs).collect()} == {("r", "/a/b/x.py", "/a/b"), ("r", "/a/b2/y.py", "/a"), ("r", "/a/b/c/z.py", "/a/b/c")}
    assert {(r["path"], r["parent"], r["depth"]) for r in paths.tree(dirs).collect()} == {("/a", None, 0), ("/a/b", "/a", 1), ("/a/b/c", "/a/b", 2)}


def test_nearest(spark):
    a = spark.createDataFrame([(1, 100), (1, 500), (2, 100)], "k int, ms long")
    b = spark.createDataFrame([(1, 90, "x"), (1, 110, "y"), (1, 700, "z")], "k int, ms long, name string")
    assert {(r["k"], r["ms"], r["near_name"]) for r in paths.nearest(a, b, ["k"], "ms", "ms", 100).collect()} == {(1, 100, "x")}


def test_names_resolve_once_or_by_import(spark):
    targets = spark.createDataFrame([("r", "A", "p.A"), ("r", "A", "q.A"), ("r", "B", "p.B"), ("s", "B", "s.B")], "repo_id string, name string, fqn string")
    raw = spark.createDataFrame([("r", "p.C", "A"), ("r", "p.C", "B"), ("r", "p.D", "A"), ("r", "p.C", "B")], "repo_id string, source string, name string")
    once = graph.resolve_unique(raw, targets)
    assert {tuple(r) for r in once.collect()} == {("r", "p.C", "p.B")}
    imports = spark.createDataFrame([("r", "p.D", "q.A")], "repo_id string, source string, target string")
    assert {tuple(r) for r in graph.resolve_imported(raw, targets, imports, once).collect()} == {("r", "p.D", "q.A")}
    assert graph.resolve_as_coded(raw, targets).count() == 5


def test_calls(spark):
    mth = spark.createDataFrame([("r", "p.A#f", "f", "p.A"), ("r", "p.A#g", "g", "p.A"), ("r", "p.B#h", "h", "p.B"), ("r", "p.B#get", "get", "p.B")], "repo_id string, fqn string, name string, class_fqn string")
    raw = spark.createDataFrame([("r", "p.A#f", "p.A", "g"), ("r", "p.A#g", "p.A", "h"), ("r", "p.A#g", "p.A", "get"), ("r", "p.A#f", "p.A", "h")], "repo_id string, caller string, class_fqn string, name string")
    first = graph.calls_same_class(raw, mth)
    assert {tuple(r) for r in first.collect()} == {("r", "p.A#f", "p.A#g")}
    assert {tuple(r) for r in graph.calls_same_package(raw, mth, first).collect()} == {("r", "p.A#g", "p.B#h")}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", None), (3, "e", 1)], "id int, v string, t int")
    assert {(r["id"], r["v"]) for r in graph.upsert(old, new, ["id"], "t").collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert {r["id"] for r in graph.insert_absent(old, new, ["id"]).collect()} == {1, 2, 3}
    assert {(r["id"], r["v"]) for r in graph.replace_scope(old, new.where("id = 1"), ["id"]).collect()} == {(1, "c"), (2, "b")}


def test_delete_files_takes_edges_along(spark):
    nodes = spark.createDataFrame([("r", "A", "f1"), ("r", "B", "f2")], "repo_id string, fqn string, file_path string")
    e = spark.createDataFrame([("r", "A", "B"), ("r", "B", "B")], "repo_id string, source string, target string")
    kept, left = graph.delete_files(nodes, e, spark.createDataFrame([("r", "f1")], "repo_id string, file_path string"))
    assert [r["fqn"] for r in kept.collect()] == ["B"] and [tuple(r) for r in left.select("source", "target").collect()] == [("B", "B")]


def score(spark, expr, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select(expr(F.col("v")).alias("s")).collect()
    return [r["s"] for r in rows]


def test_score_steps(spark):
    size = lambda v: scoring.steps(v, scoring.SIZE_STEPS)
    assert score(spark, size, [5, 10, 15, 20, 25, 30, 60, 61, 200]) == [25, 25, 18, 18, 10, 10, 4, 0, 0]
    assert score(spark, lambda v: scoring.steps(v, scoring.BLAST_STEPS), [0, 5, 6, 20, 50, 100, 101]) == [25, 20, 12, 12, 5, 2, 0]
    assert score(spark, lambda v: scoring.steps(v, scoring.COUPLING_STEPS, below=True), [0, 0.05, 0.10, 0.20, 0.35, 0.5, 0.9]) == [25, 25, 20, 12, 6, 0, 0]
    assert score(spark, scoring.grade, [100, 80, 79, 65, 64, 50, 49, 35, 34, 0]) == ["A", "A", "B", "B", "C", "C", "D", "D", "F", "F"]
    assert score(spark, lambda v: scoring.tier(v, F.lit(0)), [61, 31, 16, 6, 5]) == ["god", "large", "medium", "small", "tiny"]


def test_signals_count_each_side_and_cap(spark):
    lines = [("c", x) for x in ("+import requests", "+requests.get(u)", "+ requests.post (u)", "-log.info('a')", "-logger.error('b')", "+++ requests.get(x)", "--- log.info(x)", " requests.get(u)", "+hash(x)", "-verify(x)", None)] + [("d", "diff --git a/x b/requirements.txt"), ("d", "+torch==2.0"), ("d", "-numpy==1.0"), ("e", "+torch==2.0")]
    got = {r["commit_sha"]: r for r in signals.hits(spark.createDataFrame(lines, "commit_sha string, line string")).collect()}
    assert (got["c"]["new_external_http_call"], got["c"]["crypto_function_changed"], got["c"]["net_log_decrease"], got["c"]["new_third_party_lib"]) == (2, 2, 2, 1)
    assert (got["d"]["new_package_added"], got["d"]["package_removed"], got["d"]["heavy_package_added"]) == (1, 1, 1)
    assert got["e"]["new_package_added"] == 0
    scored = signals.vectors(signals.hits(spark.createDataFrame([("f", "+os.getenv('SECRET_KEY')")] * 9, "commit_sha string, line string")).withColumn("callers", F.lit(25))).first()
    assert scored["security"] == round(1.5 / 8.5, 4) and scored["availability"] == round(1.5 / 6.5, 4)
    assert signals.risk(signals.vectors(signals.hits(spark.createDataFrame([], "commit_sha string, line string")))).count() == 0


def test_blast_sizes_hold_no_pairs(spark, monkeypatch):
    """A giant component: nothing as large as its pairs is written, and workers and joins give the same sizes."""
    pairs = [(k, (k + d) % 300) for k in range(300) for d in (1, 7)] + [(300 + k, 301 + k) for k in range(6)] + [(306, 0), (5, None), (9, 9)]
    rows, write = [], closure.cut

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(closure, "cut", counted)
    got = {(r["node"], r["size"]) for r in closure.blast_sizes(edges(spark, pairs), 50).collect()}
    assert max(rows) <= len(pairs)
    assert got == {(r["node"], r["size"]) for r in closure.blast_sizes(edges(spark, pairs), 50, 0).collect()}
    assert got == {(k, 50) for k in range(300)} | {(301 + k, k + 1) for k in range(6)}


def test_importers_by_workers_and_by_joins(spark):
    """Importers and theirs of each key count once, however many paths lead to them; both ways give the same rows."""
    rows = [(f"n{a}", f"n{b}") for a in range(90) for b in range(90) if (a * 7 + b * 3) % 11 == 0] + [("n1", "n1"), ("x", "n0"), ("y", "x"), (None, "n0")]
    named = [(k, f"n{k * j % 90}") for k in range(40) for j in range(1, 4)] + [(40, "y"), (41, "unknown"), (42, "x")]
    by = {}
    for a, b in rows:
        if a is not None and a != b:
            by.setdefault(b, set()).add(a)
    want = set()
    for k in range(43):
        first = set().union(*[by.get(n, set()) for key, n in named if key == k])
        if first:
            want.add((k, len(first), len(set().union(*[by.get(n, set()) for n in first]))))
    edges, keys = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame(named, "key long, node string").distinct()
    for limit in (1 << 20, 0):
        assert {tuple(r) for r in closure.importers(edges, keys, limit).collect()} == want


def test_scores_write_no_pairs_of_documents(spark):
    """The graph around the documents' classes is counted by workers: no join of what each document leads to is left."""
    plan = activity.vector_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3


def test_risk_searches_documents_once(spark):
    """The risk goes on from the scores' own rows; the lines aren't searched a second time for the graph's columns."""
    plan = activity.commit_risk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and plan.count("Join ") <= 3
    scored = spark.createDataFrame([("c", *[0.5] * 6)], "commit_sha string, " + ", ".join(f"{v} double" for v in signals.VECTOR_WEIGHTS))
    apart = signals.risk(scored, spark.createDataFrame([("c", 4, 2)], "commit_sha string, direct long, endpoints long"))
    along = signals.risk(scored.withColumns({"direct": F.lit(4), "endpoints": F.lit(2)}))
    assert apart.collect() == along.collect() == [("c", round(0.5 * 0.7 + 0.36 * 0.3, 4))]


def test_hits_of_odd_lines(spark):
    """Lines of CRLF, of file headers, without a sign or null; packages count once a commit, and known ones don't."""
    lines = ["+import numpy as np\r", "+import numpy", "-import pandas", "+from os import path", "+  requests>=2.0\r", "+++ import torch", "--- a", None, "", "import scipy", "diff --git a/x b/db/V1__a.sql\r", "diff --git a/x b/pom.xml", "-  log.info('x')", "- logger.warn(1)", "+log.error(2)", "+\tfor x in y:", "+F\u00fcr sha256(x)", "-hmac"]
    got = signals.hits(spark.createDataFrame([("a", x) for x in lines] + [("b", None)], "commit_sha string, line string")).collect()
    counted = {r["commit_sha"]: {k: v for k, v in r.asDict().items() if v and k != "commit_sha"} for r in got}
    assert counted == {"a": {"crypto_function_changed": 1, "loop_pattern_changed": 1, "heavy_lib_imported": 2, "new_migration": 1, "heavy_package_added": 2, "net_log_decrease": 1, "new_third_party_lib": 2}, "b": {}}
