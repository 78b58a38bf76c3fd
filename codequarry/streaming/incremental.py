"""Structured Streaming forms of the incremental parts: windows, keyed upserts and state.

Streams read tables as they grow. ``run`` drives one to the end of what is there now, which serves tests and catch-up alike;
in service the same plans run with a processing-time trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import graph
from codequarry.tables import checkpoint_dir


def stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A growing Parquet table as a stream, of the schema that it has now."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [x.rsplit("/", 1)[-1] for x in now.inputFiles()] == [name]:  # a table of one file, which a stream reads by its folder
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream ``df`` gives up to now, as a table in the shared checkpoint folder."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{base}/out")
    else:  # each batch gives the whole result, the last one stays
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out once their window is closed."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def gap_windows(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Visits of users, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once(rows: DataFrame, keys: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Rows of a stream by key, repeated deliveries within the watermark left out."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


#: Parts by key into which an upserted table is cut; a batch writes those anew that it has rows of.
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The batches that wrote each bucket below ``path``, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/n=*/b=*")
    found: dict[int, list[int]] = {}
    for status in root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or ():
        at = status.getPath()
        found.setdefault(int(at.getName()[2:]), []).append(int(at.getParent().getName()[2:]))
    return {b: sorted(n) for b, n in found.items()}


def _held(spark: SparkSession, path: str, before: int | None = None, buckets: set[int] | None = None) -> list[str]:
    """The folders of the newest version of each bucket, of those that batches earlier than ``before`` wrote."""
    out = []
    for b, numbers in _versions(spark, path).items():
        numbers = [n for n in numbers if before is None or n < before]
        if numbers and (buckets is None or b in buckets):
            out.append(f"{path}/n={numbers[-1]}/b={b}")
    return out


def upsert_into(path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the newest row of each key below ``path``.

    The table lies in buckets by key. A batch reads and writes only the buckets that it has keys of, as its own version of them;
    older versions go, but for the one before. A batch that is run again after a failure reads the same earlier versions and
    writes the same, so its effect is had once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = graph.upsert(batch.limit(0), batch, keys, order).withColumn("b", bucket).persist()
        touched = {r["b"] for r in new.select("b").distinct().collect()}  # at most ``buckets``
        held = _held(spark, path, number, touched)
        both = graph.upsert(spark.read.schema(batch.schema).parquet(*held), new.drop("b"), keys, order).withColumn("b", bucket) if held else new
        both.repartition("b").write.partitionBy("b").mode("overwrite").parquet(f"{path}/n={number}")
        new.unpersist()
        for b, numbers in _versions(spark, path).items():
            for n in [n for n in numbers if n < number][:-1]:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/n={n}/b={b}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return apply


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of a stream, by upserts batch after batch. A stream without rows gives none."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"
    df.writeStream.foreachBatch(upsert_into(f"{base}/out", keys, order)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    held = _held(spark, f"{base}/out")
    return spark.read.schema(df.schema).parquet(*held) if held else spark.createDataFrame([], df.schema)


def _moves(key: tuple, batches: Iterator, state) -> Iterator:
    """Heads of one repository that differ from the one before."""
    import pandas as pd

    held = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ms", "head"])
    out = []
    for ms, head in zip(rows["ms"], rows["head"]):
        if head != held:
            out.append((key[0], int(ms), "full" if held is None else "incremental"))
            held = head
    state.update((held,))
    yield pd.DataFrame(out, columns=["repo_id", "ms", "scan_type"])


def head_moves(heads: DataFrame) -> DataFrame:
    """(repo_id, ms, scan_type): a full scan at a repository's first head, an incremental one whenever the head changes.

    heads: a stream of repo_id, ms, head; the last head of each repository is state.
    """
    return heads.groupBy("repo_id").applyInPandasWithState(_moves, "repo_id string, ms long, scan_type string", "head string", "append", "NoTimeout")
