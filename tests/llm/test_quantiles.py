import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.llm.quantiles import PER_MILLE, Sketch, merge, percentiles, sketches


def exact(x, per_mille):
    xs = sorted(x)
    return [xs[max(1, -(-q * len(xs) // 1000)) - 1] for q in per_mille]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300))
def test_exact_while_small(x):
    s = Sketch()
    s.update(np.array(x))
    assert s.exact and s.percentiles(PER_MILLE) == exact(x, PER_MILLE)


def test_error_stays_within_the_bound():
    for seed in range(8):
        x = np.random.default_rng(seed).lognormal(8, 2, 120_000)
        total = Sketch()
        for part in np.array_split(x, 1 + 9 * seed):
            s = Sketch()
            s.update(part)
            total.merge(Sketch.from_bytes(s.to_bytes()))
        assert total.n == sum(c.size << h for h, c in enumerate(total.levels)) == len(x)
        xs = np.sort(x)
        for q, v in zip(PER_MILLE, total.percentiles(PER_MILLE)):
            low, high = np.searchsorted(xs, v, "left") / len(x), np.searchsorted(xs, v, "right") / len(x)
            assert max(0, low - q / 1000, q / 1000 - high - 1 / len(x)) <= total.error(q)
        assert len(total.to_bytes()) < 120_000


def test_groups(spark):
    rows = [("a", 1, k) for k in range(100)] + [("a", 2, None), ("b", 1, 5), (None, 1, 7), (None, 1, 9)]
    df = spark.createDataFrame(rows, "model string, day int, value int").repartition(3)
    held = sketches(df, ["model", "day"], F.col("value"))
    got = {(r["model"], r["day"]): (r["n"], r["p50"], r["rank_error_3se_p99"]) for r in percentiles(held, ["model", "day"]).collect()}
    assert got == {("a", 1): (100, 49.0, 0.0), ("b", 1): (1, 5.0, 0.0), (None, 1): (2, 7.0, 0.0)}
    whole = {r["model"]: r["n"] for r in merge(held, ["model"]).collect()}
    assert whole == {"a": 100, "b": 1, None: 2}
    assert sketches(df.limit(0), ["model"], F.col("value")).count() == 0
