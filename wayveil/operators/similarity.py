"""Pairs of trips, their scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.scalar import haversine_m, unit_hash
from wayveil.functions.tables import cut, ranked
from wayveil.functions.workers import ready
from wayveil.operators.grid import TRIP
from wayveil.operators.network import network_distance


def trajs(pts: DataFrame) -> DataFrame:
    """dataset, traj_id, pts: points in order."""
    return pts.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("pts"))


def sample_pairs(left: DataFrame, right: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(i, j): `most` random pairs of ids without building the cross: ranks are drawn, then looked up by two joins."""
    spark = left.sparkSession
    rank = lambda df, name: ranked(df, ["traj_id"], f"r_{name}").withColumnRenamed("traj_id", name)
    a, b = left.select("traj_id").distinct(), right.select("traj_id").distinct()
    m, n = a.count(), b.count()
    if m * n <= 4 * most:  # few pairs in all: drawing with repeats would miss some
        every = a.select(F.col("traj_id").alias("i")).crossJoin(b.select(F.col("traj_id").alias("j")))
        return every.orderBy(unit_hash(F.col("i"), F.col("j"), seed=seed), "i", "j").limit(most)
    draws = spark.range(4 * most + 16).select("id", F.least(F.floor(unit_hash(F.col("id"), F.lit(0), seed=seed) * m), F.lit(m - 1)).alias("r_i"), F.least(F.floor(unit_hash(F.col("id"), F.lit(1), seed=seed) * n), F.lit(n - 1)).alias("r_j"))
    once = draws.groupBy("r_i", "r_j").agg(F.min("id").alias("id")).orderBy("id").limit(most)
    return once.join(rank(a, "i"), "r_i").join(rank(b, "j"), "r_j").select("i", "j")


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, measure) -> DataFrame:
    """(i, j, score); left and right: (traj_id, pts). measure: a column function of two arrays."""
    ready(pairs.sparkSession)
    both = pairs.join(left.select(F.col("traj_id").alias("i"), F.col("pts").alias("a")), "i").join(right.select(F.col("traj_id").alias("j"), F.col("pts").alias("b")), "j")
    return both.select("i", "j", measure("a", "b").alias("score"))


def score_on_network(pairs: DataFrame, left: DataFrame, right: DataFrame, edges: DataFrame, measure, cutoff: float = 10_000.0) -> DataFrame:
    """(i, j, score) by distances over the road network; left and right: (traj_id, nodes), at most some 50 nodes a trip.

    measure: a matrix_measure. Distances are found once for each pair of nodes that some pair of trips needs.
    """
    ready(pairs.sparkSession)
    both = cut(pairs.join(left.select(F.col("traj_id").alias("i"), F.col("nodes").alias("a")), "i").join(right.select(F.col("traj_id").alias("j"), F.col("nodes").alias("b")), "j"))
    grid = both.select("i", "j", F.posexplode("a").alias("p", "u"), "b").select("i", "j", "p", "u", F.posexplode("b").alias("q", "v"))
    far = cut(network_distance(grid.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), edges, cutoff)).toDF("u", "v", "d")
    cells = grid.join(far, ["u", "v"]).groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q", "d"))), lambda x: x["d"]).alias("d"))
    whole = both.select("i", "j", F.size("a").alias("m"), F.size("b").alias("n")).join(cells, ["i", "j"], "left")
    return whole.select("i", "j", measure(F.coalesce("d", F.array().cast("array<double>")), "m", "n").alias("score"))


def trip_length(pts: DataFrame, segs: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(dataset, traj_id, metres): by segments where a trip has some, else along its points; 0 for under two points."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    step = pts.select(*TRIP, haversine_m(F.lag("x").over(own), F.lag("y").over(own), F.col("x"), F.col("y")).alias("m"))
    along = step.groupBy(*TRIP).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("along"))
    if segs is None:
        return along.withColumnRenamed("along", "metres")
    by = segs.join(edges.select(F.col("edge_id").alias("segment_id"), "length"), "segment_id").groupBy(*TRIP).agg(F.sum("length").alias("by_segment"))
    return along.join(by, TRIP, "left").select(*TRIP, F.coalesce("by_segment", "along").alias("metres"))


def length_group(m: Column) -> Column:
    return F.when(m <= 750, "small").when(m <= 1250, "medium").when(m >= 2000, "large").otherwise("gap")


def summarise(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("low"), F.percentile("score", 0.5).alias("median"), F.max("score").alias("high"))


def compare(o: DataFrame, s: DataFrame, measure, most: int, seed: int = 42) -> DataFrame:
    """(comparison, i, j, score) for original-original, original-synthetic and synthetic-synthetic pairs."""
    out = None
    for name, a, b in (("OO", o, o), ("OS", o, s), ("SS", s, s)):
        part = score_pairs(sample_pairs(a, b, most, seed), a, b, measure).select(F.lit(name).alias("comparison"), "i", "j", "score")
        out = part if out is None else out.union(part)
    return out


def compare_by_length(o: DataFrame, s: DataFrame, lengths: DataFrame, measure, most: int, seed: int = 42) -> DataFrame:
    """(group, i, j, score): original-synthetic pairs of one length group."""
    grouped = lengths.select("traj_id", length_group(F.col("metres")).alias("group")).where("group != 'gap'").distinct()
    left, right = (cut(df.join(grouped, "traj_id").select("group", "traj_id", "pts")) for df in (o, s))
    out = None
    for group in ("small", "medium", "large"):
        a, b = (df.where(F.col("group") == group) for df in (left, right))
        pairs = cut(sample_pairs(a, b, most, seed))
        some = lambda df, c: df.join(F.broadcast(pairs.select(F.col(c).alias("traj_id")).distinct()), "traj_id", "left_semi")  # noqa: E731  `most` rows
        part = score_pairs(pairs, some(a, "i"), some(b, "j"), measure).select(F.lit(group).alias("group"), "i", "j", "score")
        out = part if out is None else out.union(part)
    return out


def size_stats(pts: DataFrame, segs: DataFrame) -> DataFrame:
    """Points and segments of trips by dataset: least, mean, most."""
    n = pts.groupBy(*TRIP).agg(F.count("*").alias("points")).join(segs.groupBy(*TRIP).agg(F.count("*").alias("segments")), TRIP, "left").fillna(0, ["segments"])
    return n.groupBy("dataset").agg(*[f(c).alias(f"{c}_{k}") for c in ("points", "segments") for k, f in (("min", F.min), ("avg", F.avg), ("max", F.max))])
