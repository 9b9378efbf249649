"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class _Open(threading.local):
    """Tables cut inside each open scratch of a thread: operators that run at once do not delete each other's."""

    def __init__(self):
        self.stack: list[dict[int, tuple[str, DataFrame]]] = []


_open = _Open()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and the session is a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them back: cuts the lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open.stack:
        _open.stack[-1][id(out)] = (path, out)  # held, so that its id stays its own
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are cut inside, all but those handed to the function it gives."""
    _open.stack.append({})

    def keep(df: DataFrame) -> DataFrame:
        known = _open.stack[-1].pop(id(df), None)
        if known and len(_open.stack) > 1:
            _open.stack[-2][id(df)] = known  # the caller's to delete or to keep
        return df

    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path, _ in _open.stack.pop().values():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place (0, 1, ...) of each row in the order of columns that no two rows share.

    Ranks inside ranges of the order, plus the ranges' totals, so no task sees more than a range.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return spread.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")  # a row a range


def with_share(df: DataFrame, n: str, name: str) -> DataFrame:
    """Adds each row's share of the sum of column n; the sum is one row, sent to every task."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(n).alias("_all")))).withColumn(name, F.col(n) / F.col("_all")).drop("_all")
