"""Trips from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.operators.grid import Grid, assign_cell, cell_sequence

GRID = Grid(0.0, 600.0, 0.0, 100.0, 6)
LON, LAT = (-8.78, 1.04 / 600), (40.9, 0.56 / 100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(key: str):
    return F.when(F.col(key) % 2 == 0, "original").otherwise("synthetic")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip a user, from the event stream."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(side("user_id").alias("dataset"), F.col("user_id").alias("traj_id"), seq.cast("long").alias("seq"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in degrees."""
    return points(spark, sf_dir).withColumn("x", LON[0] + LON[1] * F.col("x")).withColumn("y", LAT[0] + LAT[1] * F.col("y"))


def short_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short trips, from order lines, with a segment id a point."""
    t = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return t.select(side("l_orderkey").alias("dataset"), F.col("l_orderkey").alias("traj_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), F.col("l_partkey").alias("segment_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("edge_id"), (F.col("p_partkey") % 199).alias("start_node"), ((F.col("p_partkey") * 7 + 3) % 199).alias("end_node"), F.col("p_retailprice").alias("length"))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("query_id"), (F.col("n_nationkey") * 20.0).alias("cx"), (F.col("n_nationkey") * 4.0).alias("cy"), F.lit(40.0).alias("r"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_cell(points(spark, sf_dir), GRID)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_sequence(located(spark, sf_dir))


POINTS = """pts AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'original' ELSE 'synthetic' END AS dataset, user_id AS traj_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS x,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, date_trunc('second', ts) AS ts FROM events)"""
GPS = POINTS + f""", gps AS (SELECT dataset, traj_id, seq, {LON[0]}::DOUBLE + {LON[1]!r}::DOUBLE * x AS x, {LAT[0]}::DOUBLE + {LAT[1]!r}::DOUBLE * y AS y, ts FROM pts)"""
SHORT = """trips AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'original' ELSE 'synthetic' END AS dataset, l_orderkey AS traj_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS seq,
 l_extendedprice / 1000 AS x, l_quantity AS y, l_partkey AS segment_id FROM lineitem)"""
EDGES = "edges AS (SELECT p_partkey AS edge_id, p_partkey % 199 AS start_node, (p_partkey * 7 + 3) % 199 AS end_node, p_retailprice AS length FROM part)"
CIRCLES = "circles AS (SELECT n_nationkey AS query_id, n_nationkey * 20.0::DOUBLE AS cx, n_nationkey * 4.0::DOUBLE AS cy, 40.0::DOUBLE AS r FROM nation)"
LOCATED = POINTS + f""", located AS (SELECT *, CAST(least(greatest(floor((x - 0.0::DOUBLE) / {GRID.w!r}::DOUBLE), 0), 5) * 6 + least(greatest(floor((y - 0.0::DOUBLE) / {GRID.h!r}::DOUBLE), 0), 5) AS INTEGER) AS cell FROM pts)"""
CELLS = LOCATED + """, kept AS (SELECT * FROM (SELECT *, lag(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS before FROM located) WHERE before IS NULL OR before <> cell),
 cells AS (SELECT dataset, traj_id, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY seq) - 1 AS seq, cell FROM kept)"""
ENDS = CELLS + """, ends AS (SELECT dataset, traj_id, arg_min(cell, seq) AS src, arg_max(cell, seq) AS dst, count(*) AS length FROM cells GROUP BY ALL)"""
MOVES = CELLS + """, moves AS (SELECT * FROM (SELECT dataset, traj_id, cell AS src, lead(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS dst, count(*) OVER (PARTITION BY dataset, traj_id) AS length FROM cells) WHERE dst IS NOT NULL)"""
