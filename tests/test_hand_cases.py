"""Order-dependent operators on cases worked out by hand, and properties of models and walks."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayveil.functions import measures
from wayveil.functions.scalar import time_index
from wayveil.operators import attack, clean, grid, model, network, synth, utility
from wayveil.plans import adapters as a

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def pts(spark, rows):
    return spark.createDataFrame([("original", t, k, float(x), float(y), T0 + timedelta(seconds=s)) for t, k, x, y, s in rows], "dataset string, traj_id long, seq long, x double, y double, ts timestamp")


def test_cleaning_compares_with_the_last_kept_point(spark):
    raw = pts(spark, [(1, 0, 0, 0, 0), (1, 1, 0.01, 0, 10), (1, 2, 0.0002, 0, 20), (1, 3, 0.0004, 0, 2000)])
    got = [(r.seq, r.part) for r in clean.clean_split(raw, ["dataset", "traj_id"]).orderBy("seq").collect()]
    assert got == [(0, 0), (2, 0), (3, 1)]


def test_split_before_speed(spark):
    raw = pts(spark, [(1, 0, 0, 0, 0), (1, 1, 9.0, 0, 1000), (1, 2, 9.0002, 0, 1000)])
    got = [(r.seq, r.part) for r in clean.clean_split(raw, ["dataset", "traj_id"], max_distance=None, split_first=True, bad_if_no_time=True).orderBy("seq").collect()]
    assert got == [(0, 0), (1, 1)]


def test_closed_edges(spark):
    g = grid.Grid(0.0, 10.0, 0.0, 10.0, 10)
    p = pts(spark, [(1, 0, 3.0, 0.5, 0)])
    cell = lambda mode: grid.assign_cell(p, g, mode).first()["cell"]
    assert (cell("closed_first"), cell("floor_clamp"), cell("bins_left")) == (20, 30, 20)
    assert sorted(r.cell for r in grid.assign_all_closed(p, g).collect()) == [20, 30]


def test_lone_cell_and_route(spark):
    lone = spark.createDataFrame([("o", 1, 0, 7), ("o", 1, 1, 7)], "dataset string, traj_id long, seq long, cell int")
    assert grid.cell_sequence(lone).count() == 1 and grid.cell_sequence(lone, pad_single=True).count() == 2
    far = spark.createDataFrame([("o", 1, 0, 0), ("o", 1, 1, 31)], lone.schema)
    assert [r.cell for r in grid.fill_route(far, 10).orderBy("seq").collect()] == [0, 11, 21, 31]


def test_time_edges(spark):
    rows = spark.createDataFrame([(T0,), (T0 + timedelta(minutes=15),), (T0 + timedelta(minutes=16),)], "ts timestamp")
    assert [r[0] for r in rows.orderBy("ts").select(time_index(F.col("ts"), "00:00:00", 15)).collect()] == [0, 0, 1]


@pytest.mark.parametrize("values, want", [([-2, 1, 3, 5], [0, 0, 2, 5]), ([-9, 1, 3], [0, 0, 0])])
def test_queue_minus(spark, values, want):
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(values)], "src int, dst int, w double")
    assert [r.w for r in model.queue_minus(df, ["src"]).orderBy("dst").collect()] == want


def test_pair_measures(spark):
    seg = "array<struct<id:long,length:double>>"
    row = spark.createDataFrame([([(1, 10.0), (2, 20.0), (3, 30.0)], [(2, 20.0), (3, 30.0)])], f"a {seg}, b {seg}")
    assert row.select(measures.lors()("a", "b")).first()[0] == -50
    point = "array<struct<x:double,y:double>>"
    two = spark.createDataFrame([([], [(0.0, 0.0), (1.0, 1.0)]), ([(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0)])], f"a {point}, b {point}")
    at = lambda m: [r[0] for r in two.select(m("a", "b")).collect()]
    assert at(measures.measure("edr")) == [2, 0] and at(measures.measure("erp", gap=3.0)) == [6, 0] and at(measures.measure("dtw"))[1] == 0
    ids = spark.createDataFrame([([1, 2, 3], [2, 3])], "a array<long>, b array<long>")
    assert ids.select(measures.measure("lcrs")("a", "b")).first()[0] == -2 / 3


def test_edit_table_against_the_plain_recursion():
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.random((7, 5))
    for step in (0.3, 1.0):
        d = np.zeros((8, 6))
        d[:, 0], d[0] = np.arange(8) * step, np.arange(6) * step
        for i in range(7):
            for j in range(5):
                d[i + 1, j + 1] = min(d[i, j] + m[i, j], d[i, j + 1] + step, d[i + 1, j] + step)
        assert math.isclose(measures.edit_table(m, step), d[-1, -1])


def test_count_split(spark):
    starts = spark.createDataFrame([(0, 10)], "cell int, n long")
    moves = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.3)], "src int, dst int, p double")
    got = {tuple(r.cells): r.copies for r in synth.synth_count_split(starts, moves).collect()}
    assert sum(got.values()) == 10 and got.keys() <= {(0, 0), (0, 1), (0, 2)}


def test_count_split_of_one_start_spreads_over_rounds(spark):
    starts = spark.createDataFrame([(0, 3000), (1, 1), (2, 0)], "cell int, n long")
    moves = spark.createDataFrame([(a, b, 0.3) for a in range(4) for b in range(4) if a != b], "src int, dst int, p double")
    whole, rounds = (sorted((tuple(r.cells), r.copies) for r in synth.synth_count_split(starts, moves, max_len=9, steps=n).collect()) for n in (10**6, 40))
    assert whole == rounds and sum(n for _, n in whole) == 3001 and max(len(c) for c, _ in whole) > 4


def test_neighbours_rule(spark):
    got = {}
    for r in grid.neighbours(spark, 20).collect():
        got.setdefault(r.cell, set()).add(r.other)
    assert len(got) == 400 and all(v == {i * 20 + j for i in range(20) for j in range(20) if abs(i - c // 20) <= 1 and abs(j - c % 20) <= 1} for c, v in got.items())


def test_models_sum_to_one_and_noise_fades(spark):
    c = a.cells(spark, SF)
    for eps in (None, 1e9):
        sums = model.transitions_weighted(c, 6, eps=eps).groupBy("src").agg(F.sum("w").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-6 or r.s == 0 for r in sums)
    noise = spark.range(20_000).select(model.laplace([F.col("id")], 2.0).alias("v")).agg(F.avg("v").alias("m"), F.avg(F.abs("v")).alias("b")).first()
    assert abs(noise.m) < 0.02 and abs(noise.b - 0.5) < 0.02


def test_walks(spark):
    c = a.cells(spark, SF)
    lens = model.fit_extra_lengths(c, 6)
    one = synth.synth_grid_markov(model.od_counts(c), lens, model.transitions_weighted(c, 6), 6, 40)
    two = synth.synth_grid_markov(model.od_counts(c).repartition(3), lens, model.transitions_weighted(c, 6), 6, 40)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    steps = model.moves(one).select(F.greatest(F.abs(F.floor(F.col("src") / 6) - F.floor(F.col("dst") / 6)), F.abs(F.col("src") % 6 - F.col("dst") % 6)).alias("k")).agg(F.max("k")).first()[0]
    assert steps <= 1


def test_divergence(spark):
    p = spark.createDataFrame([(1, 1.0)], "k int, p double")
    q = spark.createDataFrame([(2, 1.0)], "k int, p double")
    assert math.isclose(utility.jsd(p, q, ["k"]).first()[0], math.log(2)) and utility.jsd(p, p, ["k"]).first()[0] == 0


def test_network_distance(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5.0), (2, 1, 2, 5.0), (3, 0, 2, 50.0), (4, 1, 0, 4.0), (5, 8, 9, 1.0)], "edge_id long, start_node long, end_node long, length double")
    pairs = spark.createDataFrame([(0, 2), (0, 0), (0, 9)], "a long, b long")
    assert {(r.a, r.b): r.d for r in network.network_distance(pairs, edges).collect()} == {(0, 2): 9.0, (0, 0): 0.0, (0, 9): 10_000.0}


def test_registry_and_segments(spark):
    p = pts(spark, [(1, 0, 0, 0, 0), (1, 1, 1, 0, 1), (1, 2, 1, 0, 2), (1, 3, 0, 0, 3), (2, 0, 1, 0, 0), (2, 1, 2, 0, 1)])
    nodes, edges = network.build_registry(p)
    assert [r.node_id for r in nodes.orderBy("lon").collect()] == [0, 1, 2]
    assert {(r.edge_id, r.start_node, r.end_node) for r in edges.collect()} == {(0, 0, 1), (1, 1, 0), (2, 1, 2)}
    walked = p.withColumn("node_id", F.col("x").cast("long"))
    segs = network.legs_to_segments(walked, edges)
    assert {(r.traj_id, r.order, r.segment_id) for r in segs.collect()} == {(1, 0, 0), (1, 1, 1), (2, 0, 2)}
    alone = pts(spark, [(9, 0, 7, 7, 0)])
    got = network.attach_network(p.union(alone), segs, nodes).orderBy("traj_id", "seq").collect()
    assert [(r.traj_id, r.seq, r.node_id) for r in got] == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 1), (2, 1, 2), (9, 0, None)]
    times = {(r.traj_id, r.seq): r.ts for r in p.collect()}
    assert [r.ts for r in got[:5]] == [times[1, 0], times[1, 1], times[1, 2], times[2, 0], times[2, 1]]
    assert network.geometry_to_segments(p, nodes, edges).count() == 3
    more = pts(spark, [(5, 0, 9, 9, 0), (5, 1, 1, 0, 1), (5, 2, 0, 0, 2)])
    n2, e2 = network.build_registry(more, (nodes, edges))
    assert {r.node_id for r in n2.collect()} == {0, 1, 2, 3} and {(r.edge_id, r.start_node, r.end_node) for r in e2.collect()} == {(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 3, 1)}


def test_nearest_node_and_anchor_times(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "node_id long, lon double, lat double")
    p = pts(spark, [(1, 0, 0.1, 0, 0), (1, 1, 40, 40, 1)])
    assert {r.seq: r.node_id for r in network.nearest_road(p, nodes).collect()} == {0: 1, 1: 2}
    g = spark.createDataFrame([("o", 1, k, t) for k, t in enumerate([None, 10, None, None, 40, None])], "dataset string, traj_id long, seq long, t long")
    assert [r.t for r in network.interp_anchor_times(g).orderBy("seq").collect()] == [None, 10, 20, 30, 40, 40]


def test_top_outliers_and_known_regions(spark):
    s = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0)], "id long, score double")
    assert [r.id for r in attack.top_outliers(s, 2).collect()] == [2, 2] and [r.id for r in attack.top_outliers(s, 2, exact=False).collect()] == [2, 3]
    same = spark.createDataFrame([(d, t, b, b) for d, t in (("original", 1), ("synthetic", 2)) for b in range(4)], "dataset string, traj_id long, bin int, region int")
    assert tuple(attack.reidentification(same, 2).first()) == (1, 1.0, 1.0)


def test_scores_of_whole_trips(spark):
    from wayveil.functions.measures import measure
    from wayveil.operators import similarity
    from wayveil.plans import catalog

    d = "/root/testdata/sf0.001"
    trips = {r.traj_id: (r.dataset, r.pts) for r in similarity.trajs(a.gps(spark, d)).collect()}
    got = {(r.comparison, r.i, r.j): r.score for r in catalog.queries()["t6_compare_dtw"](spark, d).collect()}
    sides = {"OO": ("original", "original"), "OS": ("original", "synthetic"), "SS": ("synthetic", "synthetic")}
    pairs = [(c, i, j) for c, (x, y) in sides.items() for i in trips for j in trips if (trips[i][0], trips[j][0]) == (x, y)]
    assert got.keys() == set(pairs) and max(len(p) for _, p in trips.values()) > 50
    rows = spark.createDataFrame([(c, i, j, trips[i][1], trips[j][1]) for c, i, j in pairs], "c string, i long, j long, a array<struct<seq:long,x:double,y:double>>, b array<struct<seq:long,x:double,y:double>>")
    want = {(r.c, r.i, r.j): r.score for r in rows.select("c", "i", "j", measure("dtw")("a", "b").alias("score")).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=6e-7) for k in want)  # the query rounds to six decimals


def test_long_walks_keep_their_length(spark):
    od = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, p double")
    lengths = spark.createDataFrame([(0, 1, 2000.0)], "src long, dst long, length double")
    matrix = spark.createDataFrame([(i, j, 0.25) for i in range(4) for j in range(4)], "src long, dst long, w double")
    walked = synth.synth_median_length(od, lengths, matrix, 2, 20).groupBy("traj_id").count().collect()
    want = {k: max(2, round(-np.log(synth._uniform(0, np.array([k]), 1)[0]) * 2000.0 / np.log(2))) for k in range(20)}
    assert {r.traj_id: r["count"] for r in walked} == want and max(want.values()) > 200
