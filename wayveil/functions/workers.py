"""Python workers that can import this package, also where it is not installed (a checkout on every machine)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Put the checkout on the workers' path; on a cluster without it, ship the package with --py-files instead."""
    known = spark.sparkContext.environment
    paths = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that are few bytes and much work; adaptive execution does not join tasks of a stated number."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
