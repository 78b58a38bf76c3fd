"""Percentiles of very large columns from mergeable sketches with relative rank error.

The sketch is a tower of relative compactors. A full compactor sorts its buffer, leaves the part nearest to the protected tail
alone and hands every second item of the rest to the next level, where an item stands for twice as many. Compactions grow
deeper by the schedule of trailing ones of a counter, and sections multiply with their number. The rank error at a percentile
thereby is in proportion to its distance from the protected end: percentile 99.9 is a hundred times as exact as 90.
Sketches merge level by level; days, files or partitions combine to the whole in any order.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.tables import read

#: Items of a section; the relative standard error of a rank is about 0.13 / SECTION.
SECTION, SECTIONS = 128, 3
#: Percentiles in thousandths.
PER_MILLE = (500, 900, 950, 990, 999)
#: Groups that a task sketches at a time.
GROUPS = 4000
#: Parts into which the sketches of one group are merged first.
PARTS = 16


class Compactor:
    """One level: a buffer of values, the counter of its compactions, and its sections."""

    __slots__ = ("chunks", "size", "state", "section", "sections")

    def __init__(self, section: float = SECTION, sections: int = SECTIONS):
        self.chunks: list[np.ndarray] = []
        self.size, self.state, self.section, self.sections = 0, 0, float(section), sections

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self._even()

    def _even(self) -> int:
        return max(4, 2 * round(self.section / 2))

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.chunks.append(values)
            self.size += len(values)

    def values(self) -> np.ndarray:
        if len(self.chunks) != 1:
            self.chunks = [np.concatenate(self.chunks)] if self.chunks else [np.zeros(0)]
        return self.chunks[0]

    def compact(self) -> np.ndarray:
        """The items that move up. The largest values, at the protected end, stay."""
        buf = np.sort(self.values())
        deep = 1
        while self.state >> (deep - 1) & 1 and deep < self.sections:
            deep += 1
        stay = self.capacity // 2 + (self.sections - deep) * self._even()
        move = max(0, len(buf) - stay) // 2 * 2
        up = buf[zlib.crc32(buf[:move].tobytes(), self.state) & 1 : move : 2]  # a coin that repeats itself on the same data
        self.chunks, self.size = [buf[move:]], len(buf) - move
        self.state += 1
        if self.state >= 1 << (self.sections - 1):
            shorter = self.section / math.sqrt(2)
            if shorter >= 4:
                self.section, self.sections = shorter, 2 * self.sections
        return up


class Sketch:
    """Relative-rank sketch of numbers, exact at the high end."""

    def __init__(self, section: int = SECTION):
        self.base = section
        self.n = 0
        self.levels = [Compactor(section)]

    def update(self, values: np.ndarray) -> None:
        values = np.asarray(values, "float64")
        self.n += len(values)
        self.levels[0].add(values)
        self._settle()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.base))
        for mine, its in zip(self.levels, other.levels):
            mine.state |= its.state
            if its.sections > mine.sections:
                mine.sections, mine.section = its.sections, its.section
            mine.add(its.values())
        self._settle()

    def _settle(self) -> None:
        at = 0
        while at < len(self.levels):
            level = self.levels[at]
            while level.size >= level.capacity:
                up = level.compact()
                if at + 1 == len(self.levels):
                    self.levels.append(Compactor(self.base))
                self.levels[at + 1].add(up)
                if not len(up):
                    break
            at += 1

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def error(self, per_mille: int) -> float:
        """Bound of the error of a rank in shares of all rows, at three standard errors; 0 while nothing was compacted."""
        if self.exact:
            return 0.0
        return 3 * math.sqrt(0.0512 / SECTIONS) / self.base * (1 - per_mille / 1000)

    def percentiles(self, per_mille: tuple[int, ...]) -> list[float | None]:
        """For each the smallest held value up to which at least that share of all rows lies; None of no rows."""
        if not self.n:
            return [None] * len(per_mille)
        values = np.concatenate([c.values() for c in self.levels])
        weights = np.concatenate([np.full(c.size, 1 << h, "int64") for h, c in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        goal = [max(1, -(-q * int(ranks[-1]) // 1000)) for q in per_mille]
        return [float(values[order[min(int(np.searchsorted(ranks, g)), len(order) - 1)]]) for g in goal]

    def to_bytes(self) -> bytes:
        out = [struct.pack("<iiq", self.base, len(self.levels), self.n)]
        for c in self.levels:
            out += [struct.pack("<qdii", c.state, c.section, c.sections, c.size), c.values().astype("<f8").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        base, levels, n = struct.unpack_from("<iiq", data)
        self, at = cls(base), 16
        self.n, self.levels = n, []
        for _ in range(levels):
            state, section, sections, size = struct.unpack_from("<qdii", data, at)
            c = Compactor(section, sections)
            c.state = state
            c.add(np.frombuffer(data, "<f8", size, at + 24).copy())
            at += 24 + 8 * size
            self.levels.append(c)
        return self


def _partial(batches: Iterator, keys: list[str]) -> Iterator:
    """One sketch for each group of a partition."""
    import pandas as pd

    held: dict[tuple, Sketch] = {}
    for pdf in batches:
        codes, groups = pd.MultiIndex.from_frame(pdf[keys]).factorize()
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(groups) + 1))
        values = pdf["value"].to_numpy("float64")[order]
        for k, group in enumerate(groups):
            held.setdefault(tuple(None if x != x else x for x in group), Sketch()).update(values[bounds[k] : bounds[k + 1]])
        if len(held) > GROUPS:
            yield _rows(held, keys)
            held = {}
    if held:
        yield _rows(held, keys)


def _rows(held: dict[tuple, Sketch], keys: list[str]):
    import pandas as pd

    return pd.DataFrame([(*group, s.n, s.to_bytes()) for group, s in held.items()], columns=[*keys, "n", "sketch"])


def _merged(batches: Iterator, keys: list[str]) -> Iterator:
    """One sketch for each run of equal keys; the rows come sorted, so one sketch is held at a time."""
    group, total, done = None, None, {}
    for pdf in batches:
        for *key, data in zip(*(pdf[k].tolist() for k in keys), pdf["sketch"]):
            key = tuple(None if x != x else x for x in key)
            if total is None or key != group:
                if total is not None:
                    done[group] = total
                    if len(done) >= GROUPS:
                        yield _rows(done, keys)
                        done = {}
                group, total = key, Sketch.from_bytes(data)
            else:
                total.merge(Sketch.from_bytes(data))
    if total is not None:
        done[group] = total
        yield _rows(done, keys)


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long", "sketch binary"])


def sketches(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, n, sketch): a sketch of ``value`` in each group of ``keys``.

    Null and NaN values are left out, null keys are a group of their own. Each partition sketches its groups first, so a hot
    group is never collected; what is shuffled are sketches.
    """
    own = df.select(*keys, value.cast("double").alias("value")).where("value is not null and not isnan(value)")
    schema = _schema(own, keys)
    return merge(own.mapInPandas(lambda batches: _partial(batches, keys), schema), keys)


def merge(held: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """(keys, n, sketch): the sketches of ``held`` (keys, n, sketch) combined by ``keys``, which may be fewer than before."""
    schema = _schema(held, keys)
    step = lambda df, by: df.repartition(*by).sortWithinPartitions(*keys).select(*keys, "sketch").mapInPandas(lambda batches: _merged(batches, keys), schema)
    salted = held.select(*keys, "sketch", F.pmod(F.xxhash64("sketch"), F.lit(parts)).alias("_part"))
    return step(step(salted, [*keys, "_part"]), keys)


def _read_off(batches: Iterator, keys: list[str], per_mille: tuple[int, ...]) -> Iterator:
    for pdf in batches:
        held = [Sketch.from_bytes(x) for x in pdf["sketch"]]
        got = [s.percentiles(per_mille) for s in held]
        out = pdf[[*keys, "n"]].copy()
        for k, q in enumerate(per_mille):
            out[_name(q)] = [x[k] for x in got]
        out["rank_error_3se_p50"] = [s.error(500) for s in held]
        out["rank_error_3se_p99"] = [s.error(990) for s in held]
        yield out


def _name(per_mille: int) -> str:
    return f"p{per_mille // 10}" if per_mille % 10 == 0 else f"p{per_mille}"


def percentiles(held: DataFrame, keys: list[str], per_mille: tuple[int, ...] = PER_MILLE) -> DataFrame:
    """(keys, n, p50, ..., rank_error_3se_p50, rank_error_3se_p99) of sketches.

    An error is a share of all rows, at three standard errors: about one percentile in 400 may be further off.
    """
    types = dict(held.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long", *(f"{_name(q)} double" for q in per_mille), "rank_error_3se_p50 double", "rank_error_3se_p99 double"])
    return held.mapInPandas(lambda batches: _read_off(batches, keys, per_mille), schema)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call once, with its day in UTC; times that are null or not positive are no durations and left out.

    Repeated deliveries make a shuffle needed before any count; what it moves is the key and the four short columns in use.
    """
    day = F.date_format(F.timestamp_millis(iso_ms(F.col("ts"))), "yyyy-MM-dd").alias("day")
    calls = read(spark, sf_dir, "llm_calls", "id", "ts", "model", "source", "elapsed_ms").where("elapsed_ms > 0")
    return calls.select("id", "model", "source", "elapsed_ms", day).distinct()


DAILY = ["model", "source", "day"]


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of elapsed_ms by model, source and day."""
    return percentiles(sketches(_calls(spark, sf_dir), DAILY, F.col("elapsed_ms")), DAILY)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of elapsed_ms by model and source, combined from the sketches of the days."""
    days = sketches(_calls(spark, sf_dir), DAILY, F.col("elapsed_ms"))
    return percentiles(merge(days, ["model", "source"]), ["model", "source"])


def p3_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches by model, source and day, to be kept and combined."""
    return sketches(_calls(spark, sf_dir), DAILY, F.col("elapsed_ms"))


def p3_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of elapsed_ms by model alone, combined from the sketches of the days: groups large enough to be compacted."""
    return percentiles(merge(sketches(_calls(spark, sf_dir), DAILY, F.col("elapsed_ms")), ["model"]), ["model"])


def p3_error_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, n, within): whether each percentile of ``p3_by_model`` has a rank within its error of the one asked for."""
    got = p3_by_model(spark, sf_dir)
    each = got.select("model", "n", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(_name(q)).alias("at")) for q in PER_MILLE])), (F.col("rank_error_3se_p50") * 2).alias("error"))
    calls = _calls(spark, sf_dir).select(F.coalesce("model", F.lit("")).alias("m"), "elapsed_ms")
    met = calls.join(F.broadcast(each.withColumn("m", F.coalesce("model", F.lit("")))), "m")  # five rows for each model
    ranks = met.groupBy("model", "n", "q", "at", "error").agg(F.count_if(F.col("elapsed_ms") < F.col("at")).alias("below"), F.count_if(F.col("elapsed_ms") <= F.col("at")).alias("upto"))
    goal, slack = F.col("q") / 1000 * F.col("n"), (1 - F.col("q") / 1000) * F.col("error") * F.col("n") + 1
    return ranks.groupBy("model", "n").agg(F.every((F.col("below") <= goal + slack) & (F.col("upto") >= goal - slack)).alias("within"))


_ONCE = """
WITH c AS (SELECT DISTINCT id, ts, model, source, elapsed_ms FROM llm_calls WHERE elapsed_ms > 0),
d AS (SELECT *, strftime(CAST(CASE WHEN regexp_matches(ts, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY elapsed_ms) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM d)
SELECT {keys}, max(n) AS n, {qs}, CAST(0 AS DOUBLE) AS rank_error_3se_p50, CAST(0 AS DOUBLE) AS rank_error_3se_p99 FROM r GROUP BY {keys}
"""
_QS = ", ".join(f"CAST(min(CASE WHEN rn >= (n * {q} + 999) // 1000 THEN elapsed_ms END) AS DOUBLE) AS {_name(q)}" for q in PER_MILLE)
#: Exact percentiles; the sketches agree with them while no group is large enough to be compacted.
SQL = {"p3_daily": _ONCE.format(keys="model, source, day", qs=_QS), "p3_percentiles": _ONCE.format(keys="model, source", qs=_QS)}
SQL["p3_error_check"] = "SELECT model, count(DISTINCT id) AS n, true AS within FROM llm_calls WHERE elapsed_ms > 0 GROUP BY model"
QUERIES = {"p3_daily": p3_daily, "p3_percentiles": p3_percentiles, "p3_by_model": p3_by_model, "p3_error_check": p3_error_check, "p3_sketches": p3_sketches}
