"""Pairs of a search hold their query's points: a small file of them is much memory, so they are not sent to every task."""

from pyspark.sql import functions as F

from wayveil.functions.tables import cut
from wayveil.operators import sequences
from wayveil.operators.sequences import SequenceTree


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_meet_sequences_and_deep_levels_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sequences, "SMALL", 2)  # so that a level is a deep one
    point = lambda v: F.struct(v.cast("double").alias("x"), F.lit(0.0).alias("y"))
    tree = SequenceTree(spark.range(40).select(F.col("id").alias("j"), F.array(point(F.col("id")), point(F.col("id") + 1)).alias("q")), 4)
    asked = cut(spark.range(3).select("id", F.array(point(F.col("id")), point(F.col("id"))).alias("p")))
    live = cut(asked.withColumn("node", F.lit(0).cast("long")))
    assert tree.levels[1][1] > 2 and "Broadcast" not in _plan(tree._down(live, 1))
    assert "Broadcast" not in _plan(tree._pairs(live))
    assert [(r.id, r.j, r.d) for r in tree.nearest(asked).orderBy("id").collect()] == [(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0)]
