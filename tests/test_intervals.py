from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.operators import intervals


def brute(rows):
    by = {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and a < b:
            by.setdefault(k, []).append((a, b))
    gaps, periods = set(), set()
    for k, xs in by.items():
        cur = None
        for a, b in sorted(xs):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    periods.add((k, *cur))
                    gaps.add((k, cur[1], a))
                cur = [a, b]
        periods.add((k, *cur))
    return gaps, periods


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 60)), st.one_of(st.none(), st.integers(0, 60))), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, a long, b long")
    args = (F.col("k"), F.col("a"), F.col("b"), 7)
    gaps, periods = brute(rows)
    assert {tuple(r) for r in intervals.gaps(df, *args).collect()} == gaps
    assert {tuple(r) for r in intervals.periods(df, *args).collect()} == periods


def test_hot_entity_over_many_buckets(spark):
    df = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 9).alias("b"), F.lit(1).alias("_t"), F.lit(2).alias("entity"))
    got = intervals.gaps(df, F.col("k"), F.col("a"), F.col("b"), 100)
    assert got.count() == 2999
    assert got.agg(F.min(F.col("gap_end_ms") - F.col("gap_start_ms"))).first()[0] == 1


def test_empty(spark):
    df = spark.createDataFrame([], "k string, a long, b long")
    assert intervals.gaps(df, F.col("k"), F.col("a"), F.col("b")).count() == 0


def test_times(spark):
    rows = [("2017-06-01T02:00:00.000+02:00", 1496275200000), ("2017-06-01 00:00:00", 1496275200000), ("2017-06-01T00:00:00Z", 1496275200000), ("2017-06-01T00:00:00,5Z", 1496275200500), ("2017-06-01T00:00:00.123999+00:00", 1496275200123), ("2017-06-01T05:30:00+0530", 1496275200000), ("junk", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, want long").select(iso_ms(F.col("s")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
