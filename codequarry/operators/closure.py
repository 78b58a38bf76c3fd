"""Reachability, depth, cycles and walks on edge tables (src, dst).

Rounds are joins of a frontier with the edges; what was found before is taken away by an anti join. Lineage is cut every round
by a table in the shared checkpoint folder, so a lost executor costs one round.
"""

from __future__ import annotations

import functools
import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codequarry.tables import BROADCAST_BYTES, cut, release

#: Rounds between two checkpoints.
CUT_EVERY = 4


def reach(edges: DataFrame, seeds: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(src, dst, hops): every node other than src that can be reached from src, with the least number of hops.

    seeds: src; all sources without it. Cycles and self edges end by themselves; null ends are left out; no edges, no rows.
    """
    own = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    step = own.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    front = (own if seeds is None else own.join(seeds.select("src").distinct(), "src", "left_semi")).withColumn("hops", F.lit(1))
    front = cut(front)
    found = [front]
    hops = 1
    while (max_hops is None or hops < max_hops) and not front.isEmpty():
        hops += 1
        seen = reduce(DataFrame.unionByName, found)
        front = front.join(step, "dst").where("next <> src").select("src", F.col("next").alias("dst")).distinct()
        front = cut(front.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        found.append(front)
        if len(found) > CUT_EVERY:
            found = [cut(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


def blast_sizes(edges: DataFrame, stop: int = 500, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(node, size): how many nodes depend on each node, directly or not; ``stop`` stands for that many or more.

    Nodes go by numbers. Edges of up to ``limit`` bytes, counted, are sent to all workers, which follow each node by itself, so that
    no pairs are held at all; larger graphs go by rounds of joins, with the same rows. Nodes that none depends on have no row.
    """
    own = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    ids = cut(own.select(F.col("src").alias("key")).unionByName(own.select(F.col("dst").alias("key"))).distinct().withColumn("id", F.monotonically_increasing_id()))
    end = lambda c, to: ids.select(F.col("key").alias(c), F.col("id").alias(to))
    back = cut(own.join(end("dst", "node"), "dst").join(end("src", "by"), "src").select("node", "by"))
    small = back.count() * 4 + ids.count() * 12 <= limit
    sizes = _sizes_by_workers(back, stop) if small else _sizes_by_joins(back, stop)
    return ids.join(sizes.withColumnRenamed("node", "id"), "id").select(F.col("key").alias("node"), "size")


def _shared(back: DataFrame):
    """The edges back (node, by) at the workers: the nodes' numbers, where each one's edges start, and the places that these lead to."""
    import numpy as np

    rows = back.toArrow()
    node, by = rows["node"].to_numpy(), rows["by"].to_numpy()
    ids = np.unique(np.concatenate([node, by]))
    node, by = np.searchsorted(ids, node), np.searchsorted(ids, by)
    starts = np.searchsorted(node[order := np.argsort(node, kind="stable")], np.arange(len(ids) + 1))
    return back.sparkSession.sparkContext.broadcast((ids, starts.astype(np.int32), by[order].astype(np.int32)))


def _sizes_by_workers(back: DataFrame, stop: int) -> DataFrame:
    """``blast_sizes`` of a graph that each worker can hold, back: node, by."""
    spark, shared = back.sparkSession, _shared(back)
    deal = spark.range(0, len(shared.value[0]), 1, 4 * spark.sparkContext.defaultParallelism)
    return deal.mapInArrow(functools.partial(_follow, shared=shared, stop=stop), "node long, size long")


def _follow(batches, shared, stop: int):
    """The sizes of nodes by place. A node that a full one depends on is full, and isn't followed further."""
    import pyarrow as pa

    ids, starts, by = shared.value
    starts, by, full = starts.tolist(), by.tolist(), set()
    for batch in batches:
        places, sizes = [], []
        for v in batch.column(0).to_pylist():
            if starts[v] == starts[v + 1]:
                continue
            seen, queue = {v}, [v]
            for u in queue:
                more = [w for w in by[starts[u] : starts[u + 1]] if w not in seen]
                seen.update(more)
                queue += more
                if len(seen) > stop or not full.isdisjoint(more):
                    full.add(v)
                    break
            places.append(v)
            sizes.append(stop if v in full else len(seen) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[places], pa.int64()), pa.array(sizes, pa.int64())], ["node", "size"])


def _sizes_by_joins(back: DataFrame, stop: int) -> DataFrame:
    """``blast_sizes`` of a graph of any size, back: node, by, written.

    A node that reached ``stop``, or that a node with so many depends on, isn't followed further: no more than the bound and one
    round's growth is held of any node, however large the graph.
    """
    step = back.select(F.col("node").alias("by"), F.col("by").alias("next"))
    count = lambda df: df.groupBy("node").agg(F.count("*").alias("size"))
    front, found, sizes = back, [back], cut(count(back))
    while True:
        full = sizes.where(F.col("size") >= stop).select("node")
        ahead = front.join(full, "node", "left_anti").join(step, "by").where("node <> next").select("node", F.col("next").alias("by")).distinct()
        front = cut(ahead.join(reduce(DataFrame.unionByName, found), ["node", "by"], "left_anti"))
        if front.isEmpty():
            return sizes.select("node", F.least("size", F.lit(stop)).alias("size"))
        found.append(front)
        if len(found) > CUT_EVERY:
            found, old = [cut(reduce(DataFrame.unionByName, found))], found
            release(*[x for x in old if x is not back and x is not front])
        heirs = front.join(full.withColumnRenamed("node", "by"), "by", "left_semi").select("node", F.lit(stop).cast("long").alias("size")).distinct()
        sizes, old_sizes = cut(sizes.unionByName(count(front)).unionByName(heirs).groupBy("node").agg(F.sum("size").alias("size"))), sizes
        release(old_sizes)


def importers(edges: DataFrame, named: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, callers, transitive): how many nodes have an edge to a node of each key, and how many have one to those.

    edges: src, dst; named: key, node. Nodes go by numbers. Edges of up to ``limit`` bytes, counted, are sent to all workers, which
    unite the nodes of each key by bits, so that no pairs of key and node are written; larger graphs go by joins, with the same rows.
    Keys whose nodes have no edge have no row.
    """
    own = cut(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    ids = cut(own.select(F.col("src").alias("name")).unionByName(own.select(F.col("dst").alias("name"))).distinct().withColumn("id", F.monotonically_increasing_id()))
    end = lambda c, to: ids.select(F.col("name").alias(c), F.col("id").alias(to))
    back = cut(own.join(end("dst", "node"), "dst").join(end("src", "by"), "src").select("node", "by"))
    found = named.withColumnRenamed("node", "name").join(ids, "name").select("key", F.col("id").alias("node"))
    if back.count() * 4 + ids.count() * 12 <= limit:
        return _importers_by_workers(back, found.groupBy("key").agg(F.collect_set("node").alias("nodes")))
    step = lambda df: df.join(back, "node").select("key", F.col("by").alias("node")).distinct()
    first = cut(step(found))
    count = lambda df, c: df.groupBy("key").agg(F.count("*").alias(c))
    return count(first, "callers").join(count(step(first), "transitive"), "key", "left").select("key", "callers", F.coalesce("transitive", F.lit(0)).alias("transitive"))


def _importers_by_workers(back: DataFrame, named: DataFrame) -> DataFrame:
    """``importers`` of a graph that each worker can hold, back: node, by; named: key, nodes."""
    key = named.schema["key"]
    return named.mapInArrow(functools.partial(_unite, shared=_shared(back)), StructType([key, StructField("callers", LongType()), StructField("transitive", LongType())]))


#: Bytes of united nodes that a worker keeps; what goes beyond is made anew.
UNITED_BYTES = 64 << 20


def _unite(batches, shared):
    """The counts of each key, by bits of places; what one node and two hops give is kept while there is room."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, starts, by = shared.value
    starts, flags, near, far = starts.tolist(), np.zeros(len(ids), bool), {}, {}
    room = UNITED_BYTES // (len(ids) // 8 + 64)

    def bits(v: int) -> int:
        if v not in near:
            if len(near) >= room:
                near.clear()
            flags[:] = False
            flags[by[starts[v] : starts[v + 1]]] = True
            near[v] = int.from_bytes(np.packbits(flags).tobytes(), "big")
        return near[v]

    def further(v: int) -> int:
        if v not in far:
            if len(far) >= room:
                far.clear()
            flags[:] = False
            for u in by[starts[v] : starts[v + 1]].tolist():
                flags[by[starts[u] : starts[u + 1]]] = True
            far[v] = int.from_bytes(np.packbits(flags).tobytes(), "big")
        return far[v]

    for batch in batches:
        rows = []
        for nodes in batch.column(1).to_pylist():
            places = np.searchsorted(ids, nodes).tolist()
            rows.append((reduce(operator.or_, map(bits, places)).bit_count(), reduce(operator.or_, map(further, places)).bit_count()))
        counts = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
        out = pa.RecordBatch.from_arrays([batch.column(0), *counts], ["key", "callers", "transitive"])
        yield out.filter(pc.greater(counts[0], 0))


def dependents(edges: DataFrame, changed: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops): nodes that depend on one of ``changed`` (node) in at most max_hops steps, the changed ones left out.

    Each hop is written once, as the next one and the union of all read it. A node found at several lengths has the least.
    """
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).where("node <> next").distinct()
    front = changed.select("node").distinct()
    levels = []
    for hop in range(1, max_hops + 1):
        front = cut(front.join(back, "node").select(F.col("next").alias("node")).distinct())
        levels.append(front.withColumn("hops", F.lit(hop)))
    found = reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.min("hops").alias("hops"))
    return found.join(changed.select("node").distinct(), "node", "left_anti")


def dependents_by(edges: DataFrame, changed: DataFrame, max_hops: int) -> DataFrame:
    """(package, node, hops): as ``dependents``, for each package of ``changed`` (package, node) apart."""
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).where("node <> next").distinct()
    own = changed.select("package", "node").distinct()
    front, levels = own, []
    for hop in range(1, max_hops + 1):
        front = cut(front.join(back, "node").select("package", F.col("next").alias("node")).distinct())
        levels.append(front.withColumn("hops", F.lit(hop)))
    found = reduce(DataFrame.unionByName, levels).groupBy("package", "node").agg(F.min("hops").alias("hops"))
    return found.join(own, ["package", "node"], "left_anti")


def depth_to_root(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, depth): the longest chain of edges from each node up to a node without outgoing edge.

    Nodes whose chains run only in cycles have none; max_depth bounds the rounds against cycles.
    """
    own = edges.select("src", "dst").where("src <> dst").distinct()
    level = cut(own.select(F.col("dst").alias("node")).distinct().join(own.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(0)))
    found = [level]
    for depth in range(1, max_depth + 1):
        level = cut(level.join(own, level["node"] == own["dst"]).select(F.col("src").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("depth").alias("depth")).where("depth > 0")


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs that each have an edge to the other."""
    own = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    return own.where("src < dst").join(own.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def spine(edges: DataFrame, starts: DataFrame, layer: DataFrame, hops: int = 6) -> DataFrame:
    """(start, hop, node): a greedy walk from each start over edges to nodes of the same or a deeper layer, none twice.

    starts: node; layer: node, layer. Of the nodes next to the current one the deepest goes first, then the least name.
    """
    level = layer.select(F.col("node").alias("next"), F.col("layer").alias("next_layer"))
    walk = starts.select("node").distinct().join(layer, "node").select(F.col("node").alias("start"), F.col("node"), "layer", F.array("node").alias("path"))
    own = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    w = Window.partitionBy("start").orderBy(F.desc("next_layer"), "next")
    rows = [walk.select("start", F.lit(0).alias("hop"), "node")]
    for hop in range(1, hops + 1):
        ahead = walk.join(own, "node").join(level, "next").where("next_layer >= layer and not array_contains(path, next)")
        walk = cut(ahead.withColumn("k", F.row_number().over(w)).where("k = 1").select("start", F.col("next").alias("node"), F.col("next_layer").alias("layer"), F.array_append("path", F.col("next")).alias("path")))
        rows.append(walk.select("start", F.lit(hop).alias("hop"), "node"))
    return reduce(DataFrame.unionByName, rows)
