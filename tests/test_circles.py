"""Trips that touch circles; blocks of circles give the same counts."""

import math
import random

import pytest

from wayveil.operators import utility

POINTS = "dataset string, traj_id long, seq long, x double, y double"
CIRCLES = "query_id long, cx double, cy double, r double"


def walk(draw, t, n, step):
    x, y = draw.uniform(-5, 5), draw.uniform(-5, 5)
    out = []
    for k in range(n):
        out.append(("a", t, k, x, y))
        x, y = x + draw.choice([0.0, draw.uniform(-step, step)]), y + draw.uniform(-step, step)
    return out


def apart(c, p, q):
    dx, dy = q[3] - p[3], q[4] - p[4]
    d = dx * dx + dy * dy
    t = min(max(((c[1] - p[3]) * dx + (c[2] - p[4]) * dy) / d, 0.0), 1.0) if d else 0.0
    return math.hypot(c[1] - p[3] - t * dx, c[2] - p[4] - t * dy)


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_counts_equal_every_circle_with_every_part(spark, monkeypatch, block):
    monkeypatch.setattr(utility, "QUERY_BLOCK", block)
    draw = random.Random(4)
    rows = [r for t in range(40) for r in walk(draw, t, draw.choice([1, 2, 5, 60]), draw.choice([0.05, 1.0]))]
    rows += [("a", 90, 0, 9.0, 9.0), ("a", 90, 1, 9.0, 9.0), ("b", 3, 0, 0.0, 0.0), ("b", 3, 1, 1.0, 0.0), (None, None, 0, 0.0, 1.0), (None, None, 1, 0.5, 1.0)]
    odd = [("a", 91, 0, None, 1.0), ("a", 91, 1, 0.0, None), ("a", 92, 0, float("nan"), 0.0), ("a", 92, 1, 0.0, 0.0)]
    circles = [(k, draw.uniform(-5, 5), draw.uniform(-5, 5), draw.choice([0.0, 0.3, 2.0, 6.0, 30.0])) for k in range(20)] + [(50, 2.0, 0.0, 1.0), (51, -1.0, 0.0, 1.0)]
    trips = {}
    for r in rows:
        trips.setdefault(r[:2], []).append(r)
    pts, asked = spark.createDataFrame(rows + odd, POINTS), spark.createDataFrame(circles, CIRCLES)
    for still in (True, False):
        hit = lambda c, own: any(apart(c, p, q) <= c[3] or (still and p[3:] == q[3:]) for p, q in zip(own, own[1:]))  # noqa: E731,B023
        want = {c[0]: sum(hit(c, own) for own in trips.values()) for c in circles}
        assert dict(map(tuple, utility.touching(pts, asked, still).select("query_id", "n").collect())) == want
    near = lambda c, own: any(math.hypot(p[3] - c[1], p[4] - c[2]) <= c[3] for p in own)
    want = {c[0]: sum(near(c, own) for own in trips.values()) + (math.hypot(c[1], c[2]) <= c[3]) for c in circles}  # trip 92 has one whole point
    assert dict(map(tuple, utility.touching_points(pts, asked).select("query_id", "n").collect())) == want


def test_without_circles_or_points(spark):
    pts, asked = spark.createDataFrame([("a", 1, 0, 0.0, 0.0)], POINTS), spark.createDataFrame([(1, 0.0, 0.0, 1.0)], CIRCLES)
    assert utility.touching_points(pts, asked.where("false")).count() == 0
    assert [tuple(r) for r in utility.touching_points(pts.where("false"), asked).collect()] == [(1, 0)]
    assert [tuple(r) for r in utility.touching(pts, asked).collect()] == [(1, 0)]
