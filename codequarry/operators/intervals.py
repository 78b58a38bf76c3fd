"""Continuous periods and gaps of overlapping intervals: a sweep line over plus and minus events.

The sweep of one entity may be long, so it never runs in one task. Boundaries fall into buckets of time. A small table holds
the net count of each (entity, bucket); its running sum is what a bucket starts with, and the running sum within a bucket is
taken on top of that. A hot entity is thereby split over all its buckets, and since instants are counted before they meet, a
bucket holds no more rows than it has milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.tables import cut

#: Width of a time bucket: 6 hours.
BUCKET_MS = 6 * 3600 * 1000


def _lead_across(df: DataFrame, at: str, to: str) -> DataFrame:
    """``to``: the next value of ``at`` within the entity, also beyond the bucket's end. Needs columns ``_k``, ``_b``."""
    firsts = df.groupBy("_k", "_b").agg(F.min(at).alias("_first"))
    over = Window.partitionBy("_k").orderBy("_b")
    firsts = firsts.select("_k", "_b", F.lead("_first").over(over).alias("_beyond"))
    inside = Window.partitionBy("_k", "_b").orderBy(at)
    return df.join(firsts, ["_k", "_b"]).withColumn(to, F.coalesce(F.lead(at).over(inside), "_beyond")).drop("_beyond")


def sweep(df: DataFrame, entity: Column, start_ms: Column, end_ms: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """One row per boundary at which the number of open intervals changes.

    Columns: ``_k`` entity, ``_b`` bucket, ``_t`` instant, ``_d`` change, ``_n`` open intervals from ``_t`` on, ``_next`` the
    entity's next boundary (null at its last). Intervals with a null entity, start or end, and those that don't end after
    their start, cover nothing and are left out. Repeated rows and ties change counts, never coverage. An empty input gives
    no rows. Other columns of ``df`` play no part, whatever their names.
    """
    own = df.select(entity.alias("_k"), start_ms.cast("long").alias("_s"), end_ms.cast("long").alias("_e"))
    own = own.where(F.col("_k").isNotNull() & (F.col("_s") < F.col("_e")))
    events = own.select("_k", F.inline(F.array(
        F.struct(F.col("_s").alias("_t"), F.lit(1).cast("long").alias("_d")),
        F.struct(F.col("_e").alias("_t"), F.lit(-1).cast("long").alias("_d")),
    )))
    events = events.groupBy("_k", F.floor(F.col("_t") / bucket_ms).alias("_b"), "_t").agg(F.sum("_d").alias("_d"))
    events = cut(events.where("_d <> 0"))  # the buckets' sums and the sweep within them both read it
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy("_k", "_b").agg(F.sum("_d").alias("_net"), F.min("_t").alias("_first"))
    sums = sums.select("_k", "_b", F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_carry"), F.lead("_first").over(Window.partitionBy("_k").orderBy("_b")).alias("_beyond"))
    inside = Window.partitionBy("_k", "_b").orderBy("_t")
    counted = events.join(sums, ["_k", "_b"])
    return counted.select(
        "_k", "_b", "_t", "_d",
        (F.col("_carry") + F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("_n"),
        F.coalesce(F.lead("_t").over(inside), "_beyond").alias("_next"),
    )


def gaps(df: DataFrame, entity: Column, start_ms: Column, end_ms: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(entity, gap_start_ms, gap_end_ms): the stretches between two periods of an entity that no interval covers.

    Touching intervals leave no gap, nor is there one before the first or after the last period. See ``sweep`` for nulls,
    ties, repeated rows and empty input.
    """
    swept = sweep(df, entity, start_ms, end_ms, bucket_ms)
    return swept.where("_n = 0 and _next is not null").select(F.col("_k").alias("entity"), F.col("_t").alias("gap_start_ms"), F.col("_next").alias("gap_end_ms"))


def periods(df: DataFrame, entity: Column, start_ms: Column, end_ms: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(entity, period_start_ms, period_end_ms): the continuous covered stretches of each entity, touching ones merged."""
    swept = sweep(df, entity, start_ms, end_ms, bucket_ms).where("_n = 0 or _n = _d")
    turns = _lead_across(swept.select("_k", "_b", "_t", "_n"), "_t", "_end")
    return turns.where("_n > 0").select(F.col("_k").alias("entity"), F.col("_t").alias("period_start_ms"), F.col("_end").alias("period_end_ms"))
