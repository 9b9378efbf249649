"""Logs that are walked in blocks keep the same points as logs walked in one go."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayveil.operators import clean


def logs(spark, n):
    """One long log, one of a null key, one that stands still and ten short ones; some leaps, repeats and pauses."""
    draw = np.random.default_rng(5)
    ids = np.concatenate([np.full(n, 1), np.full(n // 2, -1), np.full(n // 2, 2), np.repeat(np.arange(3, 13), 20)])
    seq = np.concatenate([np.arange(n), np.arange(n // 2), np.arange(n // 2), np.tile(np.arange(20), 10)])
    size = len(ids)
    x = np.cumsum(draw.normal(0, 3e-4, size)) + np.where(draw.random(size) < 0.05, draw.normal(0, 2.0, size), 0)
    y = np.cumsum(draw.normal(0, 3e-4, size))
    still = ids == 2
    x[still], y[still] = 0.5, 0.5
    t = np.cumsum(draw.choice([0, 1, 2, 5, 2000], size, p=[0.1, 0.4, 0.3, 0.18, 0.02]))
    frame = pd.DataFrame({"log": ids, "seq": seq, "x": x, "y": y, "ts": pd.to_datetime(1_700_000_000 + t, unit="s"), "start": 1_000})
    return spark.createDataFrame(frame).withColumn("log", F.when(F.col("log") >= 0, F.col("log"))).repartition(7, "seq")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_split_in_blocks_equals_one_walk(spark):
    raw = logs(spark, 900)
    for parameters in ({}, {"max_distance": None, "split_first": True, "bad_if_no_time": True}):
        whole, parts = (clean.clean_split(raw, ["log"], block=b, **parameters) for b in (1 << 16, 100))
        want = rows(whole)
        assert whole.columns == parts.columns and want == rows(parts)
        assert len(want) > 100 and max(r[-1] for r in want) > 3


def test_fixed_rate_in_blocks_equals_one_walk(spark):
    raw = logs(spark, 600).drop("ts")
    whole, parts = (clean.clean_porto(raw, ["log"], -1.0, 1.0, -0.01, 1.0, max_speed=60.0, block=b) for b in (1 << 16, 100))
    want = rows(whole)
    assert whole.columns == parts.columns and want == rows(parts) and len(want) > 50


def test_state_that_passes_through_every_block(spark):
    """Each point but the first is too near to be kept if that one is known: guesses settle only block after block."""
    n = 200
    raw = spark.range(n).select(F.lit(1).alias("log"), F.col("id").alias("seq"), (F.col("id") % 2 * 5e-5).alias("x"), F.lit(0.0).alias("y"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = clean.clean_split(raw, ["log"], block=50).collect()
    assert [(r.seq, r.part) for r in got] == [(0, 0)]


def test_empty_log(spark):
    raw = logs(spark, 40).where("false")
    assert clean.clean_split(raw, ["log"], block=4).count() == 0
