"""The sequence tree and the wavefront against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayveil.functions import measures
from wayveil.operators import attack
from wayveil.operators.sequences import SequenceTree


def dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            d[i + 1, j + 1] = math.dist(p, q) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def lists(rng, n, most=9, spread=5.0):
    return [rng.normal(rng.normal(0, spread, 2), 1.0, (int(rng.integers(1, most)), 2)).round(2) for _ in range(n)]


def frame(spark, rows, key, name):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in v]) for i, v in rows], f"{key} long, {name} array<struct<x:double,y:double>>")


def test_wavefront_equals_the_plain_recursion(monkeypatch):
    monkeypatch.setattr(measures, "STEP", 40)
    rng = np.random.default_rng(2)
    a, b = lists(rng, 80), lists(rng, 80, 20)
    b[3], a[7] = np.zeros((0, 2)), np.zeros((0, 2))
    want = np.array([dtw(x, y) if len(x) and len(y) else np.inf for x, y in zip(a, b)])
    parts = lambda rows: ([x[:, 0] for x in rows], [x[:, 1] for x in rows])
    assert np.allclose(measures.dtw_many(*parts(a), *parts(b)), want)
    limit = rng.uniform(0, 2, 80) * np.where(np.isfinite(want), want, 1)
    got = measures.dtw_many(*parts(a), *parts(b), limit)
    assert np.allclose(got, np.where(want <= limit, want, np.inf))


def test_common_subsequences_equal_the_plain_recursion():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 6, int(rng.integers(0, 12))).tolist() for _ in range(2))
        for lengths in (None, {k: float(rng.integers(1, 9)) for k in range(5)}):
            w = lambda x: 1.0 if lengths is None else lengths.get(x, 1.0)  # noqa: B023, E731
            d = np.zeros((len(a) + 1, len(b) + 1))
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    d[i + 1, j + 1] = d[i, j] + w(x) if x == y else max(d[i, j + 1], d[i + 1, j])
            assert measures.common(a, b, lengths) == d[-1, -1]


@pytest.mark.parametrize("case", ["spread", "crowded", "single points", "few"])
def test_tree_equals_brute_force(spark, case):
    rng = np.random.default_rng(7)
    data = lists(rng, {"few": 3}.get(case, 150), 2 if case == "single points" else 7)
    if case == "crowded":  # a third of the sequences are equal
        data[:50] = [np.array([[1.0, 2.0], [1.5, 2.0]])] * 50
    asked = [*lists(rng, 25, 2 if case == "single points" else 7), data[0]]
    tree = SequenceTree(frame(spark, enumerate(data), "j", "q"), 6)
    queries = frame(spark, enumerate(asked), "id", "p")
    every = np.array([[dtw(x, y) for y in data] for x in asked])
    near = {r.id: (r.j, r.d) for r in tree.nearest(queries).collect()}
    assert {i: j for i, (j, _) in near.items()} == dict(enumerate(every.argmin(axis=1))) and np.allclose([near[i][1] for i in range(26)], every.min(axis=1))
    far = {r.id: r.d for r in tree.farthest(queries).collect()}
    assert np.allclose([far[i] for i in range(26)], every.max(axis=1))
    within = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in v], float(every[i].min()), 0.2 * float(every[i].max())) for i, v in enumerate(asked)], "id long, p array<struct<x:double,y:double>>, centre double, reach double")
    n = {r.id: r.n for r in tree.count_within(within).collect()}
    assert [n[i] for i in range(26)] == [(abs(row - row.min()) <= 0.2 * row.max()).sum() for row in every]


def test_bounds_settle_most_pairs(spark):
    rng = np.random.default_rng(9)
    data, asked = lists(rng, 2000, 7, 30.0), lists(rng, 200, 7, 30.0)
    data[:600] = [data[0]] * 600
    asked[:60] = [data[0]] * 60
    tree = SequenceTree(frame(spark, enumerate(data), "j", "q"))
    compared = tree.candidates(frame(spark, enumerate(asked), "id", "p")).count()
    assert compared < 0.04 * 2000 * 200


def test_deniability_of_parts(spark):
    rng = np.random.default_rng(5)
    data, asked = lists(rng, 120), lists(rng, 12)
    point = "v array<struct<x:double,y:double>>"
    got = attack.plausible_deniability(frame(spark, enumerate(asked), "id", "v"), spark.createDataFrame([([(float(x), float(y)) for x, y in v],) for v in data], point), None, "dtw", 0.1, 0.05, 4)
    for r in got.collect():
        row = np.array([dtw(asked[r.id], y) for y in data])
        n = (abs(row - row.min()) <= 0.05 * row.max()).sum()
        assert math.isclose(r.nearest, row.min()) and r.plausible == n and r.passes == (row.min() > 0.1 * row.max() or n >= 4)


def test_nothing_to_search(spark):
    none = frame(spark, [], "j", "q")
    tree = SequenceTree(none)
    queries = frame(spark, [(1, [(0.0, 0.0)])], "id", "p")
    assert tree.nearest(queries).count() == 0 and tree.farthest(queries).count() == 0
    assert attack.plausible_deniability(queries.withColumnRenamed("p", "v"), none.select(none.q.alias("v")), None, "dtw").count() == 0


def test_lone_points_stand_in_leaves_of_their_own(spark):
    rng = np.random.default_rng(5)
    draw = lambda: [{"x": float(x), "y": float(y)} for x, y in rng.uniform(0, 100, (1 if rng.random() < 0.8 else 3, 2))]
    data, asks = ([(k, draw()) for k in range(n)] for n in (600, 40))
    at = "array<struct<x:double,y:double>>"
    tree = SequenceTree(spark.createDataFrame(data, f"j long, q {at}"), fanout=8)
    mixed = tree.members.groupBy("node").agg(F.min("n0").alias("low"), F.max("n0").alias("high")).where("low = 1 and high > 1")
    assert mixed.count() <= 1
    side = lambda rows, v: [np.array([t[v] for t in r]) for r in rows]
    every = [(k, i, p, q) for k, p in asks for i, q in data]
    d = measures.dtw_many(*(side([e[s] for e in every], v) for s in (2, 3) for v in "xy"))
    best = {k: min((x, i) for (a, i, _, _), x in zip(every, d) if a == k) for k, _ in asks}
    found = {r.id: (r.d, r.j) for r in tree.nearest(spark.createDataFrame(asks, f"id long, p {at}")).collect()}
    assert found == best


def test_few_pairs_are_left_for_trips_that_leap(spark):
    """Trips whose points have nothing to do with each other, as those from order lines: one leaf gave a poor first guess."""
    rng = np.random.default_rng(11)
    leaps = lambda n: [rng.uniform((0, 0), (100, 50), (int(rng.integers(1, 8)), 2)).round(2) for _ in range(n)]
    tree = SequenceTree(frame(spark, enumerate(leaps(4000)), "j", "q"))
    assert tree.candidates(frame(spark, enumerate(leaps(12)), "id", "p")).count() < 0.3 * 4000 * 12


def test_bounds_hold(spark):
    rng = np.random.default_rng(13)
    data, asked = lists(rng, 300, 7, 9.0), lists(rng, 30, 7, 9.0)
    tree = SequenceTree(frame(spark, enumerate(data), "j", "q"), 8)
    pairs = tree._start(frame(spark, enumerate(asked), "id", "p"))
    for level in range(len(tree.levels)):
        pairs = tree._down(pairs, level)
        nodes = pairs.select("id", "node", "lb", "ub").collect() if level == len(tree.levels) - 1 else []
        pairs = pairs.select("id", "p", "node")
    held = {r.j: r.node for r in tree.members.select("j", "node").collect()}
    ds = {(i, j): dtw(p, q) for i, p in enumerate(asked) for j, q in enumerate(data) if j in held}
    by = {(r.id, r.node): (r.lb, r.ub) for r in nodes}
    assert all(by[i, held[j]][0] <= d * (1 + 1e-9) and d <= by[i, held[j]][1] * (1 + 1e-9) for (i, j), d in ds.items())
    alone = tree._pairs(pairs).select("id", "j", "lb", "ub").collect()
    assert len(alone) == len(ds) and all(r.lb <= ds[r.id, r.j] * (1 + 1e-9) and ds[r.id, r.j] <= r.ub * (1 + 1e-9) for r in alone)
