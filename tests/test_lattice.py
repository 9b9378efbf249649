"""Paths from many states at once are those of the search state by state, ties included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayveil.operators import adaptive
from wayveil.operators.grid import Grid
from wayveil.operators.paths import Lattice


@pytest.mark.parametrize("box", [(0.0, 6.0, 0.0, 6.0), (0.0, 600.0, 0.0, 100.0)])
def test_paths_of_a_lattice_are_the_plain_ones(spark, monkeypatch, box):
    split = [(k, m) for k, m in enumerate([5, 1, 7, 3, 9, 2, 4, 4, 8])]
    states = adaptive.cut(adaptive.states_of(Grid(*box, 3), spark.createDataFrame(split, "cell int, m int")))
    near = adaptive.cut(adaptive.subcell_neighbours(states))
    made, of = [], Lattice.of
    monkeypatch.setattr(adaptive.Lattice, "of", lambda *given: made.append(of(*given)) or made[-1])
    got = sorted(map(tuple, adaptive.state_paths(states, near).collect()))
    wanted = spark.createDataFrame([(0, 200), (0, 3), (150, 7)], "src int, dst int")
    some = sorted(map(tuple, adaptive.state_paths(states, near, wanted).collect()))
    assert made[0] is not None and made[0].states == 265
    monkeypatch.setattr(adaptive.Lattice, "of", lambda *given: None)
    assert got == sorted(map(tuple, adaptive.state_paths(states, near).collect())) and len(got) == 265**2
    assert some == sorted(map(tuple, adaptive.state_paths(states, near, wanted).collect())) and len(some) == 3


def test_a_graph_without_a_link_or_with_another_one_is_searched_plainly(spark):
    states = adaptive.states_of(Grid(0.0, 2.0, 0.0, 2.0, 2), spark.range(4).select(F.col("id").cast("int").alias("cell"), F.lit(5).alias("m")))
    near = adaptive.cut(adaptive.subcell_neighbours(states))
    fewer, more = near.where("state != 0 or other != 1"), near.union(spark.createDataFrame([(0, 99)], "state int, other int"))
    for other in (fewer, more):
        cell, x0, x1, y0, y1 = adaptive._checked(states, "state", "cell", "x0", "x1", "y0", "y1")[1:]
        a, b = adaptive._checked(other, "state", "other")
        assert Lattice.of(cell, a, b, np.round(np.hypot((x0 + x1)[a] - (x0 + x1)[b], (y0 + y1)[a] - (y0 + y1)[b]) / 2, 9)) is None


def test_an_island_is_not_reached(spark):
    states = adaptive.states_of(Grid(0.0, 2.0, 0.0, 2.0, 2), spark.range(4).select(F.col("id").cast("int").alias("cell"), F.lit(5).alias("m")))
    near = adaptive.subcell_neighbours(states)
    apart = near.where("(state < 25) = (other < 25)")
    assert adaptive.state_paths(states, apart).count() == 25**2 + 75**2


def test_a_search_over_many_states_takes_milliseconds(spark):
    """10,000 states, 10^8 pairs: the search state by state takes some 0.1 s a source."""
    import time

    states = adaptive.cut(adaptive.states_of(Grid(0.0, 4.0, 0.0, 4.0, 4), spark.range(16).select(F.col("id").cast("int").alias("cell"), F.lit(25).alias("m"))))
    near = adaptive.cut(adaptive.subcell_neighbours(states))
    began = time.time()
    assert adaptive.state_paths(states, near).count() == 10**8
    assert time.time() - began < 60
