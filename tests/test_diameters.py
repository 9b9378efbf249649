"""Diameters of short and long trips against plain code."""

import itertools
import math
import random

import pytest

from wayveil.operators import utility


def test_short_trips_are_compared_without_python(spark):
    draw = random.Random(4)
    trips = {n: [(draw.uniform(0, 9), draw.uniform(0, 9)) for _ in range(n)] for n in (1, 2, 3, 16, 17, 60)}
    trips[4] = [(1.0, 2.0)] * 4
    rows = [("original", k, s, *p) for k, t in trips.items() for s, p in enumerate(t)]
    got = utility.diameter(spark.createDataFrame(rows, "dataset string, traj_id long, seq long, x double, y double"))
    assert "HYPOT" in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r.traj_id: r.d for r in got.collect()}
    assert found == pytest.approx({k: max((math.dist(p, q) for p, q in itertools.combinations(t, 2)), default=0.0) for k, t in trips.items()})
