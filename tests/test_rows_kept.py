"""Rows that a task holds or sends on: no more than the work asks for."""

from pyspark.sql import functions as F

from wayveil.operators import grid, utility


def _trips(spark, trips, points):
    ids = spark.range(trips * points).select((F.col("id") % trips).alias("traj_id"), F.floor(F.col("id") / trips).alias("seq"))
    x, y = (F.pmod(F.col("seq") * a + F.col("traj_id") * b, F.lit(97)).cast("double") for a, b in ((31, 7), (53, 11)))
    return ids.select(F.lit("original").alias("dataset"), "traj_id", "seq", x.alias("x"), y.alias("y"), F.timestamp_seconds(F.col("seq") * 60).alias("ts"))


def test_a_trip_keeps_a_number_for_many_circles(spark):
    pts = _trips(spark, 20, 30)
    asked = spark.range(150).select(F.col("id").alias("query_id"), (F.col("id") % 97).cast("double").alias("cx"), F.lit(40.0).alias("cy"), (F.col("id") % 9).cast("double").alias("r"))
    twice = asked.union(asked.where("query_id = 3").withColumn("cx", F.lit(50.0)))  # a query of two circles counts a trip once
    found = utility.touching_points(pts, twice)
    rows, qs = pts.select("traj_id", "x", "y").collect(), twice.collect()
    want = {k: len({p.traj_id for p in rows for q in qs if q.query_id == k and (p.x - q.cx) ** 2 + (p.y - q.cy) ** 2 <= q.r**2}) for k in range(150)}
    assert {r.query_id: r.n for r in found.collect()} == want
    assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()


def test_points_between_are_numbered_without_another_shuffle(spark):
    pts = _trips(spark, 40, 25)
    g = grid.Grid(0.0, 100.0, 0.0, 100.0, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # trips go on from batch to batch
    try:
        found = grid.insert_midpoints(pts.unionByName(pts.where("traj_id = 5").withColumn("traj_id", F.lit(None).cast("long"))), g)
        got = found.orderBy("traj_id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.traj_id, []).append(r)
    assert len(by) == 41 and all([r.seq for r in rows] == list(range(len(rows))) and [r.ts for r in rows] == sorted(r.ts for r in rows) for rows in by.values())
    assert [(r.seq, r.x, r.y, r.ts) for r in by[None]] == [(r.seq, r.x, r.y, r.ts) for r in by[5]]
    given = {(r.traj_id, r.x, r.y, r.ts) for r in pts.collect()}
    assert given <= {(r.traj_id, r.x, r.y, r.ts) for r in got} and len(got) > 2 * len(given)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInPandas")[0]
