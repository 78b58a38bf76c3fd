"""Queries over a dependency graph derived from ``part``: nodes are part keys, packages their brands.

The edges are arithmetic, so that both engines have them: each part imports the one at half its key, and parts form rings of
four. The graph thereby has chains, diamonds and cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import closure, scoring
from codequarry.tables import read


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", F.col("p_partkey").alias("node"), F.col("p_brand").alias("package"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): imports of parts."""
    n = read(spark, d, "part", "p_partkey")
    half = n.where("p_partkey >= 2").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    block = F.floor(F.col("p_partkey") / 64) * 64
    ring = n.where("p_partkey % 64 < 4 and p_partkey >= 64").select(F.col("p_partkey").alias("src"), (block + (F.col("p_partkey") + 1) % 4).alias("dst"))
    return half.unionByName(ring).join(n.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").distinct()


_E = """n AS (SELECT p_partkey FROM part),
e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM n WHERE p_partkey >= 2 UNION ALL
    SELECT p_partkey, CAST(floor(p_partkey / 64) * 64 + (p_partkey + 1) % 4 AS BIGINT) FROM n WHERE p_partkey % 64 < 4 AND p_partkey >= 64) WHERE dst IN (SELECT p_partkey FROM n))"""


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes depend on each node, directly or not; 500 stands for that many or more."""
    return closure.blast_sizes(edges(spark, d))


def reach_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within three steps of each node, with the least number of steps."""
    return closure.reach(edges(spark, d), max_hops=3)


def reach_from_package(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the parts of one brand depend on."""
    seeds = nodes(spark, d).where("package = 'Brand#11'").select(F.col("node").alias("src"))
    return closure.reach(edges(spark, d), seeds).groupBy("dst").agg(F.countDistinct("src").alias("n_sources"), F.min("hops").alias("hops"))


def dependents_4hop_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """For each brand, the parts that depend on its own in at most four steps."""
    return closure.dependents_by(edges(spark, d), nodes(spark, d).select("package", "node"), 4)


def depth_to_root_ge6(spark: SparkSession, d: str) -> DataFrame:
    """Parts at the end of a chain of six or more, along the halving edges."""
    tree = read(spark, d, "part", "p_partkey").where("p_partkey >= 2").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return closure.depth_to_root(tree).where("depth >= 6")


def import_cycles_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of brands that import each other."""
    n = nodes(spark, d)
    e = edges(spark, d).join(n.select(F.col("node").alias("src"), F.col("package").alias("a")), "src").join(n.select(F.col("node").alias("dst"), F.col("package").alias("b")), "dst")
    return closure.two_cycles(e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def call_chain(spark: SparkSession, d: str) -> DataFrame:
    """The greedy walk of each start of one brand, to nodes of the same or a deeper layer."""
    layer = nodes(spark, d).select("node", (F.col("size") % 7).alias("layer"))
    starts = nodes(spark, d).where("package = 'Brand#21'").select("node")
    return closure.spine(edges(spark, d), starts, layer)


def chain_members(spark: SparkSession, d: str) -> DataFrame:
    """In how many chains each node appears."""
    return call_chain(spark, d).groupBy("node").agg(F.countDistinct("start").alias("n_chains"))


def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    i, o = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    got = nodes(spark, d).select("node", "package").join(i, "node", "left").join(o, "node", "left")
    return got.select("node", "package", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def coupling(spark: SparkSession, d: str) -> DataFrame:
    """Coupling of each node against the greatest fan-in and fan-out of all."""
    f = fan_in_out(spark, d)
    m = read(spark, d, "lineitem", F.col("l_partkey").alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    most = f.agg(F.max("fan_in").alias("most_in"), F.max("fan_out").alias("most_out"))
    got = f.join(m, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(most))  # one row
    return got.select("node", scoring.coupling(F.col("fan_in"), F.col("fan_out"), F.col("n"), F.col("most_in"), F.col("most_out")).alias("coupling"))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """What each node imports and is imported by, as ordered lists."""
    e = edges(spark, d)
    out = e.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("imports"))
    back = e.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("imported_by"))
    return out.join(back, "node", "full_outer")


def edge_schema(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of labels that an edge joins."""
    n = nodes(spark, d)
    return edges(spark, d).join(n.select(F.col("node").alias("src"), F.col("package").alias("src_label")), "src").join(n.select(F.col("node").alias("dst"), F.col("package").alias("dst_label")), "dst").select("src_label", "dst_label").distinct()


def commit_impact_2hop(spark: SparkSession, d: str) -> DataFrame:
    """For each brand as the change: parts changed, dependents at one and at up to two hops, and the brands affected."""
    n = nodes(spark, d)
    found = closure.dependents_by(edges(spark, d), n.select("package", "node"), 2).join(n.select("node", F.col("package").alias("affected")), "node")
    by = found.groupBy("package").agg(F.count_if(F.col("hops") == 1).alias("n_direct"), F.count("*").alias("n_all"), F.countDistinct("affected").alias("n_packages"))
    return n.groupBy("package").agg(F.count("*").alias("n_changed")).join(by, "package", "left").select("package", "n_changed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_direct", "n_all", "n_packages")])


def impact_report_4hop(spark: SparkSession, d: str) -> DataFrame:
    """For each brand as the change: parts changed, dependents by least number of hops up to four, and the brands affected."""
    n = nodes(spark, d)
    found = closure.dependents_by(edges(spark, d), n.select("package", "node"), 4).join(n.select("node", F.col("package").alias("affected")), "node")
    by = found.groupBy("package").agg(*[F.count_if(F.col("hops") == k).alias(f"n_hop{k}") for k in range(1, 5)], F.count("*").alias("n_all"), F.countDistinct("affected").alias("n_packages"))
    counts = [f"n_hop{k}" for k in range(1, 5)] + ["n_all", "n_packages"]
    return n.groupBy("package").agg(F.count("*").alias("n_changed")).join(by, "package", "left").select("package", "n_changed", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


QUERIES = {f.__name__: f for f in (blast_radius, reach_pairs, reach_from_package, dependents_4hop_by_brand, depth_to_root_ge6, import_cycles_2hop, call_chain, chain_members, fan_in_out, coupling, neighbourhood, edge_schema, commit_impact_2hop, impact_report_4hop)}

_BLAST = f"WITH RECURSIVE {_E}, r AS (SELECT dst AS node, src AS dep FROM e UNION SELECT r.node, e.src FROM r JOIN e ON e.dst = r.dep), b AS (SELECT node, count(*) AS size FROM r WHERE node <> dep GROUP BY node)"
_DEPENDENTS = f"""WITH RECURSIVE {_E}, r AS (SELECT p.p_brand AS package, e.src AS node, 1 AS hops FROM e JOIN part p ON p.p_partkey = e.dst WHERE e.src <> e.dst
    UNION SELECT r.package, e.src, r.hops + 1 FROM r JOIN e ON e.dst = r.node WHERE r.hops < 4 AND e.src <> e.dst),
    b AS (SELECT r.package, r.node, min(r.hops) AS hops, any_value(p.p_brand) AS affected FROM r JOIN part p ON p.p_partkey = r.node WHERE p.p_brand <> r.package GROUP BY r.package, r.node)"""
_FAN = f"WITH {_E}, f AS (SELECT p.p_partkey AS node, p.p_brand AS package, (SELECT count(*) FROM e WHERE e.dst = p.p_partkey) AS fan_in, (SELECT count(*) FROM e WHERE e.src = p.p_partkey) AS fan_out FROM part p)"
_WALK = f"""WITH RECURSIVE {_E}, l AS (SELECT p_partkey AS node, p_size % 7 AS layer, p_brand FROM part),
w AS (SELECT node AS start, 0 AS hop, node, layer, [node] AS path FROM l WHERE p_brand = 'Brand#21'
 UNION ALL SELECT start, hop + 1, nxt, nl, list_append(path, nxt) FROM (SELECT w.start, w.hop, w.path, e.dst AS nxt, l.layer AS nl, row_number() OVER (PARTITION BY w.start ORDER BY l.layer DESC, e.dst) AS k
   FROM w JOIN e ON e.src = w.node JOIN l ON l.node = e.dst WHERE w.hop < 6 AND l.layer >= w.layer AND NOT list_contains(w.path, e.dst)) WHERE k = 1)"""
SQL = {
    "blast_radius": _BLAST + " SELECT node, least(size, 500) AS size FROM b",
    "reach_pairs": f"WITH RECURSIVE {_E}, r AS (SELECT src, dst, 1 AS hops FROM e WHERE src <> dst UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE r.hops < 3) SELECT src, dst, min(hops) AS hops FROM r WHERE src <> dst GROUP BY ALL",
    "reach_from_package": f"WITH RECURSIVE {_E}, r AS (SELECT src, dst, 1 AS hops FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE r.hops < 24) SELECT dst, count(DISTINCT src) AS n_sources, min(hops) AS hops FROM r WHERE src <> dst GROUP BY dst",
    "depth_to_root_ge6": "WITH RECURSIVE r AS (SELECT p_partkey AS node, p_partkey AS cur, 0 AS depth FROM part UNION ALL SELECT node, CAST(floor(cur / 2) AS BIGINT), depth + 1 FROM r WHERE cur >= 2) SELECT node, max(depth) AS depth FROM r GROUP BY node HAVING max(depth) >= 6",
    "import_cycles_2hop": f"WITH {_E}, p AS (SELECT DISTINCT a.p_brand AS a, b.p_brand AS b FROM e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE a.p_brand <> b.p_brand) SELECT x.a, x.b FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    "call_chain": _WALK + " SELECT start, hop, node FROM w",
    "chain_members": _WALK + " SELECT node, count(DISTINCT start) AS n_chains FROM w GROUP BY node",
    "fan_in_out": _FAN + " SELECT * FROM f",
    "coupling": _FAN + ", m AS (SELECT l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1) SELECT f.node, round_even(least(0.5 * fan_in / greatest((SELECT max(fan_in) FROM f), 1) + 0.25 * fan_out / greatest((SELECT max(fan_out) FROM f), 1) + 0.25 * least(coalesce(n, 0) / 50, 1.0), 1.0), 4) AS coupling FROM f LEFT JOIN m USING (node)",
    "neighbourhood": f"WITH {_E} SELECT coalesce(a.node, b.node) AS node, imports, imported_by FROM (SELECT src AS node, array_to_string(list_sort(list(dst)), ',') AS imports FROM e GROUP BY 1) a FULL JOIN (SELECT dst AS node, array_to_string(list_sort(list(src)), ',') AS imported_by FROM e GROUP BY 1) b ON a.node = b.node",
    "edge_schema": f"WITH {_E} SELECT DISTINCT a.p_brand AS src_label, b.p_brand AS dst_label FROM e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst",
}
SQL["impact_report_4hop"] = _DEPENDENTS + """, c AS (SELECT package, """ + ", ".join(f"count(*) FILTER (hops = {k}) AS n_hop{k}" for k in range(1, 5)) + """, count(*) AS n_all, count(DISTINCT affected) AS n_packages FROM b GROUP BY package)
    SELECT o.package, n_changed, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_hop1", "n_hop2", "n_hop3", "n_hop4", "n_all", "n_packages")) + " FROM (SELECT p_brand AS package, count(*) AS n_changed FROM part GROUP BY 1) o LEFT JOIN c USING (package)"
SQL["dependents_4hop_by_brand"] = _DEPENDENTS + " SELECT package, node, hops FROM b"
SQL["commit_impact_2hop"] = _DEPENDENTS.replace("r.hops < 4", "r.hops < 2") + """, c AS (SELECT package, count(*) FILTER (hops = 1) AS n_direct, count(*) AS n_all, count(DISTINCT affected) AS n_packages FROM b GROUP BY package)
    SELECT o.package, n_changed, coalesce(n_direct, 0) AS n_direct, coalesce(n_all, 0) AS n_all, coalesce(n_packages, 0) AS n_packages FROM (SELECT p_brand AS package, count(*) AS n_changed FROM part GROUP BY 1) o LEFT JOIN c USING (package)"""
