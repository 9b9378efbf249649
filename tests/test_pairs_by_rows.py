"""Pairs of states that trips may go between stand in a row a start, not in a row a pair that is shuffled and written."""

import numpy as np
from pyspark.sql import functions as F

from wayveil.operators import adaptive, model
from wayveil.operators.grid import Grid


def test_rows_of_ends_are_the_two_step_mask(spark):
    states = adaptive.cut(adaptive.states_of(Grid(0.0, 3.0, 0.0, 3.0, 3), spark.createDataFrame([(k, m) for k, m in enumerate([4, 1, 5, 6, 2, 3, 3, 7, 4])], "cell int, m int")))
    near = adaptive.cut(adaptive.subcell_neighbours(states))
    n, rng = states.count(), np.random.default_rng(3)
    moves = spark.createDataFrame([tuple(map(int, r)) for r in rng.integers(0, n, (40, 2))], "src int, dst int")
    starts, stops = (states.where(F.expr(f"state % 3 != {k}")).select(F.col("state").alias(name), (F.col("state") % 5 + 1.0).alias("w")) for k, name in ((0, "src"), (1, "dst")))
    mask = model.two_step_mask(moves, near.select(F.col("state").alias("cell"), "other"))
    want = mask.join(starts, "src", "left_semi").join(stops, "dst", "left_semi").select("src", "dst")
    rows = adaptive.cut(adaptive.allowed_ends(moves, near, starts, stops))
    assert rows.count() == rows.select("src").distinct().count()
    pairs = lambda df: sorted(map(tuple, df.select("src", "dst").collect()))
    assert pairs(rows.select("src", F.explode("wanted").alias("dst"))) == pairs(want)
    # Calibrated by rows as by pairs, with the paths of both.
    paths = adaptive.cut(adaptive.state_paths(states, near, want))
    by_rows = adaptive.cut(adaptive.state_paths(states, near, rows, arrays=True))
    flat = by_rows.select("src", F.explode(F.arrays_zip("dst", "steps")).alias("p")).select("src", "p.dst", "p.steps")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, paths.select("src", "dst", "steps").collect()))
    a = {(r.src, r.dst): r.w for r in adaptive.calibrate_trips(starts, stops, paths, want, 9000.0).collect()}
    b = {(r.src, r.dst): r.w for r in adaptive.calibrate_rows(starts, stops, by_rows, 9000.0).collect()}
    assert a.keys() == b.keys() and len(a) > 100 and np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9)
    none = moves.where("false")
    assert adaptive.calibrate_rows(starts, stops, adaptive.state_paths(states, near, adaptive.allowed_ends(none, near, starts, stops), arrays=True), 10.0).count() == 0
