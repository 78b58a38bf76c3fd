"""Reading of the input tables and the session facts that operators rely on."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle that Python functions follow: as the session has it, but no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# Nodes of a logical plan that move or order rows.
_SHUFFLING = frozenset(("Aggregate", "Join", "Window", "Sort", "Distinct", "Deduplicate", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Intersect", "Except", "CoGroup", "FlatMapCoGroupsInArrow", "FlatMapCoGroupsInPandas", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow"))


def _shuffles(plan) -> bool:
    """Whether a JVM plan has a node that moves rows."""
    children = plan.children()
    return plan.nodeName() in _SHUFFLING or any(_shuffles(children.apply(k)) for k in range(children.length()))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that Python functions follow enough partitions for all cores.

    Small Parquet files make few splits. When the scan has fewer partitions than the cluster has cores, rows are dealt out
    again; a table whose files already make enough splits is left alone, so large inputs get no shuffle. A plan that shuffles
    is left alone too: it sets its own number by ``partitions``, and to ask for its partitions would run its stages.
    """
    if _shuffles(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, from ``spark.checkpoint.dir``.

    A session with a local master and without that setting gets a folder of its own (tests); any other without it is refused,
    since what executors wrote to their own disks would be lost to the rest.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.match(r"local(?:$|\[)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="codequarry-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends here and survives lost executors.

    ``forget`` removes what was written; a driver that ends removes it too.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not _CUTS:
        atexit.register(forget)
    _CUTS.append(path)
    df.write.parquet(path, compression="zstd")
    out = spark.read.parquet(path)
    out._cut = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that no plan will read any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path in _CUTS:
            _CUTS.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget() -> None:
    """Remove all tables that ``cut`` wrote; what was read from them can't be read again."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    while _CUTS:
        _delete(spark, _CUTS.pop())


#: Bytes of a table up to which it may be sent to all executors.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df``, a table that ``cut`` wrote, marked for broadcast if its rows of ``row_bytes`` each are within ``limit`` bytes."""
    small = df.count() * row_bytes <= limit
    return (F.broadcast(df) if small else df), small
