"""Points and distances on exact edges, and copies that must not make pairs."""

from pyspark.sql import functions as F

from wayveil.operators import adaptive, attack, network
from wayveil.operators.boxes import BoxTree
from wayveil.operators.grid import Grid, adaptive_split_trips
from wayveil.operators.sequences import SequenceTree


def test_distance_is_the_sql_one_to_the_last_bit(spark):
    """hypot puts the second original 50.00000000000001 beyond the nearest one, the SQL's square root 50.0."""
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>")
    data = spark.createDataFrame([([0.03, 0.04],), ([19.25, 46.2],)], "v array<double>")
    assert attack.plausible_deniability(asked, data, 500.0).first()["plausible"] == 2


def test_equal_sequences_and_queries_meet_once(spark):
    data = spark.range(400).select(F.col("id").alias("j"), F.array(F.struct((F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("q"))
    asked = spark.range(300).select("id", F.array(F.struct(F.lit(0.25).alias("x"), F.lit(0.0).alias("y"))).alias("p"))
    tree = SequenceTree(data)
    assert tree.size == 4
    assert {(r.j, r.d) for r in tree.nearest(asked).collect()} == {(0, 0.25)} and tree.nearest(asked).count() == 300
    counted = tree.count_within(asked.select("id", "p", F.lit(0.25).alias("centre"), F.lit(0.5).alias("reach"))).collect()
    assert len(counted) == 300 and {r.n for r in counted} == {200}


def test_states_by_their_own_edges(spark):
    """250 = 150 * (1 + 2 / 3): the division by the width rounds over the edge."""
    top = Grid(0.0, 600.0, 0.0, 100.0, 4)
    for m in (3, 6, 14, 125):
        states = adaptive.states_of(top, spark.range(16).select(F.col("id").cast("int").alias("cell"), F.lit(m).alias("m")))
        xs = [k * 150.0 / m for k in range(1, 4 * m)] + [250.0, 75.0]
        pts = spark.createDataFrame([("original", 1, k, x, 12.0) for k, x in enumerate(xs)], "dataset string, traj_id long, seq long, x double, y double")
        got = adaptive.assign_states(pts, top, states).join(states.drop("m").withColumnsRenamed({c: f"s{c}" for c in ("x0", "x1", "y0", "y1")}), "state")
        assert got.count() == len(xs)
        assert got.where("not (x > sx0 and x <= sx1 and y > sy0 and y <= sy1)").count() == 0


def test_edges_along_one_line_are_one_item(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(network, "BoxTree", lambda items: sizes.append(items.count()) or BoxTree(items))
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], "node_id long, lon double, lat double")
    edges = spark.range(600).select((F.col("id") + 5).alias("edge_id"), F.lit(0).cast("long").alias("start_node"), (F.col("id") % 2 + 1).alias("end_node"))
    pts = spark.createDataFrame([("original", 1, 0, 0.6, 0.1), ("original", 1, 1, 0.1, 0.6)], "dataset string, traj_id long, seq long, x double, y double")
    assert [r.edge_id for r in network.nearest_road(pts, nodes, edges).orderBy("seq").collect()] == [5, 6]
    assert max(sizes) <= 2 * 65


def test_sub_cells_without_trips_need_not_be_made(spark):
    """10^10 sub-cells, of which two are touched."""
    pts = spark.createDataFrame([("original", 1, 0, 0.1, 0.1, 0), ("original", 2, 0, 0.9, 0.9, 0)], "dataset string, traj_id long, seq long, x double, y double, cell int")
    dens = spark.createDataFrame([(0, 20_000.0)], "cell int, density double")
    got = adaptive_split_trips(pts, Grid(0.0, 1.0, 0.0, 1.0, 1), dens, 1, 1.0, every=False).collect()
    assert [r.m for r in got] == [100_000] * 2 and {r.share for r in got} == {0.5}


def test_searches_of_paths_are_spread_over_tasks(spark):
    """Sources are few bytes: adaptive execution put all of them in one task."""
    states = adaptive.states_of(Grid(0.0, 1.0, 0.0, 1.0, 2), spark.range(4).select(F.col("id").cast("int").alias("cell"), F.lit(3).alias("m")))
    paths = adaptive.state_paths(states, adaptive.subcell_neighbours(states))
    assert paths.count() == 36 * 36 and paths.select(F.spark_partition_id()).distinct().count() > 8
