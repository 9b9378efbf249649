"""The adaptive model, walks, defences and searches against brute force, hand cases and properties."""

import math
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayveil.operators import adaptive, attack, clean, grid, model, network, synth
from wayveil.operators.boxes import BoxTree
from wayveil.plans import adapters as a
from wayveil.plans import catalog

SF = "/root/testdata/sf0.001"


def trips(spark, rows):
    return spark.createDataFrame([("original", t, k, c) for t, cells in rows.items() for k, c in enumerate(cells)], "dataset string, traj_id long, seq long, cell int")


def test_sensitive_states_by_hand(spark):
    rows = [(-1, 0, 50.0), (-1, 1, 0.5), (0, 1, 40.0), (0, 2, 30.0), (1, 0, 20.0), (1, 2, 1.0), (2, 0, 3.0), (2, 1, 2.0), (0, -2, 0.2), (1, -2, 0.3), (2, -2, 49.0), (3, 0, 0.1)]
    matrix = spark.createDataFrame(rows, "src int, dst int, w double")
    # Enough needs over 4 * 1.414 / (1 * 0.6) = 9.43: 0 is close (40 / 30), 1 is not (20 / 1) but has 21 of 196 of all mass.
    assert {r.cell for r in model.sensitive_states(matrix, 1.0).collect()} == {0, 1, 2}
    assert {r.cell for r in model.sensitive_states(matrix, 1.0, share=0.5).collect()} == {0, 2}
    assert {r.cell for r in model.sensitive_states(matrix, 0.05, share=0.995).collect()} == set()


def test_noisy_second_order_is_whole_and_not_negative(spark):
    c = a.cells(spark, SF)
    first = model.transitions_start_end(c)
    got = model.second_order(c, model.sensitive_states(first, 5.0), first, 1.0).collect()
    assert got and all(r.w == int(r.w) and r.w >= 0 for r in got)
    again = model.second_order(c.repartition(5), model.sensitive_states(first, 5.0), first, 1.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_median_length_ranks_from_zero(spark):
    c = trips(spark, {k: [0, *[1] * 0, *([2, 3] * ((n - 2) // 2)), *([2] if n % 2 else []), 1] for k, n in enumerate([2, 4, 5, 9])} | {9: [7]})
    assert {(r.src, r.dst): r.length for r in model.dp_median_length(c, None).collect()} == {(0, 1): 5}


def test_state_paths_and_calibration(spark):
    top = grid.Grid(0.0, 4.0, 0.0, 2.0, 2)
    states = adaptive.states_of(top, spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 1)], "cell int, m int"))
    near = adaptive.subcell_neighbours(states)
    pairs = {(r.state, r.other) for r in near.collect()}
    # cell 0 is state 0, cell 1 states 1..4 (si, sj), cell 2 state 5, cell 3 state 6; rows along x, columns along y.
    assert {b for x, b in pairs if x == 0} == {1, 3, 5} and {b for x, b in pairs if x == 6} == {5, 3, 4} and {b for x, b in pairs if x == 4} == {2, 3, 6}
    paths = {(r.src, r.dst): (r.steps, r.coarse) for r in adaptive.state_paths(states, near).collect()}
    assert len(paths) == 49 and paths[0, 0] == (1, 1) and paths[0, 6] == (3, 3) and paths[1, 4] == (3, 1)
    steps = adaptive.state_paths(states, near)
    starts = spark.createDataFrame([(0, 6.0), (5, 2.0)], "src int, w double")
    stops = spark.createDataFrame([(6, 5.0), (4, 3.0)], "dst int, w double")
    got = adaptive.calibrate_trips(starts, stops, steps, steps.select("src", "dst"), 100.0).collect()
    assert math.isclose(sum(r.w for r in got), 100.0) and all(r.w > 0 for r in got)
    by = {(r.src, r.dst): r.w / paths[r.src, r.dst][0] for r in got}
    scale = sum(by.values()) / 8.0
    assert all(math.isclose(sum(v for (s, _), v in by.items() if s == src) / scale, w, rel_tol=0.02) for src, w in ((0, 6.0), (5, 2.0)))
    assert all(math.isclose(sum(v for (_, t), v in by.items() if t == dst) / scale, w, rel_tol=0.02) for dst, w in ((6, 5.0), (4, 3.0)))


def test_adaptive_walks(spark):
    states, near, walked, first, paths, trips_ = catalog._adaptive_model(a.points(spark, SF))
    top = {r.state: (r.row, r.col) for r in states.collect()}
    got = catalog.queries()["y3_synth_adaptive"](spark, SF).orderBy("traj_id", "seq").collect()
    walks = {}
    for r in got:
        walks.setdefault(r.traj_id, []).append(r.cell)
    assert len(walks) == walked.select("traj_id").distinct().count()
    for cells in walks.values():
        assert len(cells) <= 201 and all(abs(top[x][0] - top[y][0]) + abs(top[x][1] - top[y][1]) <= 1 for x, y in zip(cells, cells[1:]))


def test_markov_walks_follow_the_model(spark):
    c = trips(spark, {1: [0, 7, 14], 2: [0, 7, 14], 3: [0, 1]})
    od = model.od_counts(c)
    extra = spark.createDataFrame([(0, 14, 0.0, "poisson", 0), (0, 1, 0.0, "poisson", 0)], "src int, dst int, mean double, family string, cap int")
    got = synth.synth_grid_markov(od, extra, model.transitions_weighted(c, 6), 6, 600).orderBy("traj_id", "seq").collect()
    walks = {}
    for r in got:
        walks.setdefault(r.traj_id, []).append(r.cell)
    seen = Counter(map(tuple, walks.values()))
    assert set(seen) == {(0, 7, 14), (0, 1)} and 330 <= seen[0, 7, 14] <= 470
    far = spark.createDataFrame([(0, 35, 1.0)], "src int, dst int, p double")
    longer = spark.createDataFrame([(0, 35, 1.0, "uniform", 2)], "src int, dst int, mean double, family string, cap int")
    none = spark.createDataFrame([(1, 2, 0.0)], "src int, dst int, w double")
    lost = synth.synth_grid_markov(far, longer, none, 6, 300).groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cell"))), lambda p: p["cell"]).alias("p")).collect()
    assert {len(r.p) for r in lost} == {6, 7, 8} and all(r.p[:6] == [0, 7, 14, 21, 28, 35] and set(r.p[6:]) <= {35} for r in lost)


@pytest.mark.parametrize("family,mean,cap,want", [("uniform", 2.0, 9, 2.0), ("geometric", 1.5, 40, 1.5), ("poisson", 3.0, 40, 3.0), ("poisson", 3.0, 2, None)])
def test_families_of_extra_lengths(family, mean, cap, want):
    cum = synth._extra(family, mean, cap)
    share = np.diff(np.concatenate([[0], cum]))
    assert (share >= -1e-12).all() and math.isclose(cum[-1], 1.0)
    assert want is None or math.isclose((share * np.arange(cap + 1)).sum(), want, rel_tol=1e-4)


def test_defences(spark):
    pts = a.located(spark, SF).select("dataset", "traj_id", "seq", "x", "y", "cell")
    o, s = catalog.both(pts)
    n = s.select("traj_id").distinct().count()
    safe = catalog.queries()["y7_defend_sniffing"](spark, SF)
    assert safe.select("traj_id").distinct().count() == n
    new = safe.join(s.select("traj_id").distinct(), "traj_id", "left_anti")
    assert new.where("cell in (20, 1)").count() == 0
    out = catalog.queries()["y8_defend_outliers"](spark, SF)
    linkable = attack.leaking_outliers(o, s)[1].distinct()
    assert out.select("traj_id").distinct().count() == n and out.join(linkable, "traj_id", "left_semi").count() == 0
    oc, sc = catalog.both(a.cells(spark, SF))
    theta = 0.55
    quiet = catalog.queries()["y6_defend_bayesian"](spark, SF)
    assert attack.bayesian_attack(oc, quiet, 8, theta).first().passes and quiet.select("traj_id").distinct().count() == n


def brute_knn(points, queries, k):
    d = np.hypot(*(queries[:, None, :] - points[None]).transpose(2, 0, 1))
    own = np.hypot(*(points[:, None, :] - points[None]).transpose(2, 0, 1))
    return [own[i][np.argsort(d[i], kind="stable")[:k]].mean() for i in range(len(points))]


def test_knn_over_uneven_points(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(300, 2)) * 0.01, rng.normal(size=(40, 2)) * 5, [[100, 100], [-80, 3]]])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {r.id: r.score for r in attack.knn_score_2d(df, 7).collect()}
    assert len(got) == len(points) and np.allclose([got[k] for k in range(len(points))], brute_knn(points, points, 7))
    moved = points[::-1]
    asks = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(moved)], "id long, x double, y double")
    got = {r.id: r.score for r in attack.knn_score_2d(df, 7, asks).collect()}
    assert np.allclose([got[k] for k in range(len(points))], brute_knn(points, moved, 7))
    line = spark.createDataFrame([(k, float(v)) for k, v in enumerate(points[:, 0])], "id long, v double")
    want = [np.sort(abs(points[:, 0] - v))[:7].mean() for v in points[:, 0]]
    for block in (8, 1 << 16):
        got = {r.id: r.score for r in attack.knn_score_1d(line, 7, block).collect()}
        assert np.allclose([got[k] for k in range(len(points))], want)


def test_knn_where_a_third_of_the_points_stand_in_one_spot(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([np.full((300, 2), 0.5), rng.integers(0, 4, (300, 2)) / 2, rng.random((300, 2))])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {r.id: r.score for r in attack.knn_score_2d(df, 5).collect()}
    assert np.allclose([got[k] for k in range(len(points))], brute_knn(points, points, 5))
    asks = points[::-1]
    found = {r.id: r.score for r in attack.knn_score_2d(df, 5, spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(asks)], "id long, x double, y double")).collect()}
    own, far = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)).round(12), np.hypot(*(asks[:, None] - points[None]).transpose(2, 0, 1)).round(12)
    assert np.allclose([found[k] for k in range(len(points))], [np.sort(np.rec.fromarrays([far[k], own[k]]))[:5].f1.mean() for k in range(len(points))])
    tree = BoxTree(adaptive.cut(df.select(F.col("id").alias("j"), *[F.col(v).alias(f"{v}{k}") for v in "xy" for k in "01"])))
    met = tree.around(df, 5).groupBy("id").count().agg(F.max("count"), F.avg("count")).first()
    assert met[0] < 300 and met[1] < 120  # no query meets the spot's points one by one


def dtw(x, y):
    cost = np.full((len(x) + 1, len(y) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            cost[i + 1, j + 1] = math.dist(x[i], y[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    return cost[-1, -1]


def test_sniffing_finds_the_nearest_part(spark):
    o, s = catalog.both(a.located(spark, SF))
    sniff = s.groupBy("cell").agg(F.count_distinct("traj_id").alias("n")).orderBy(F.desc("n"), "cell").first().cell
    part = lambda df: {k: [(r.x, r.y) for r in v] for k, v in _grouped(attack.first_segment_in_cell(df, sniff)).items()}
    left, right = part(o), part(s)
    got = {r.i: r for r in attack.partial_sniffing(o, s, sniff, 1, tol=10.0).collect()}
    assert got.keys() == left.keys() and len(got) > 2
    for i, r in got.items():
        assert math.isclose(r.dtw, min(dtw(left[i], y) for y in right.values()), rel_tol=1e-9)
        mine, theirs = ([(q.x, q.y) for q in _grouped(df)[k]] for df, k in ((o, i), (s, r.j)))
        assert r.n == sum(any(math.dist(p, q) < 10 for q in theirs) for p in mine)


@pytest.mark.parametrize("least", [0.4, 0.8])
def test_reidentification_against_plain_code(spark, least):
    """Most trips stand in one region; some users tell the same, some twins are equal."""
    rng = np.random.default_rng(6)
    diaries = {i: tuple(int(r) for r in np.where(rng.random(5) < 0.6, 1, rng.integers(2, 6, 5))) for i in range(60)}
    diaries |= {60 + i: diaries[2 * i] for i in range(10)}
    rows = [("original" if i % 2 else "synthetic", i, b, r) for i, d in diaries.items() for b, r in enumerate(d)]
    frames = spark.createDataFrame(rows, "dataset string, traj_id long, bin int, region int")
    got = {r.user: (r.rate, r.found) for r in attack.reidentification(frames, 5, least).collect()}
    twins = {i: d for i, d in diaries.items() if i % 2 == 0}
    for i, d in diaries.items():
        if i % 2:
            rates = {j: sum(x == y for x, y in zip(d, e)) / 5 for j, e in twins.items()}
            best = [twins[j] for j, r in rates.items() if r == max(rates.values()) and r > least]
            guess = [max({e[b] for e in best}, key=lambda r: (sum(e[b] == r for e in best), -r)) for b in range(5)] if best else []
            assert got[i] == pytest.approx((max(rates.values()), np.mean([x == y for x, y in zip(guess, d)])) if best else (0, 0))
    assert len(got) == sum(i % 2 for i in diaries)


def _grouped(df):
    out = {}
    for r in df.orderBy("traj_id", "seq").collect():
        out.setdefault(r.traj_id, []).append(r)
    return out


def test_outlier_stages_against_plain_code(spark):
    """Every stage over the small trips, by lists."""
    o, s = catalog.both(a.points(spark, SF))
    n, k, closest, beta, kappa = 6, 3, 0.1, 0.05, 2
    theirs, mine = ({i: [(r.x, r.y) for r in v] for i, v in _grouped(df).items()} for df in (o, s))
    length = lambda p: sum(math.dist(x, y) for x, y in zip(p, p[1:]))
    xs, ys = zip(*(q for p in theirs.values() for q in p))
    box, span = math.hypot(max(xs) - min(xs), max(ys) - min(ys)), max(map(length, theirs.values())) - min(map(length, theirs.values()))
    want = []
    for stage in ("start", "end", "length"):
        at = {"start": lambda p: p[0], "end": lambda p: p[-1], "length": lambda p: (length(p),)}[stage]
        ask = (lambda p: p[0]) if stage == "end" else at
        scores = {i: np.mean([math.dist(at(p), at(mine[j])) for j in sorted(mine, key=lambda j: math.dist(ask(p), at(mine[j])))[:k]]) for i, p in mine.items()}
        top = sorted(sorted(scores), key=lambda i: -scores[i])[: n // 2 if stage == "length" else n]
        bad = []
        for i in top:
            gaps = [math.dist(at(mine[i]), at(q)) for q in theirs.values()]
            low = min(at(q)[0] - at(mine[i])[0] for q in theirs.values()) if stage == "length" else min(gaps)
            most = span if stage == "length" else box
            if low <= closest * most and sum(abs(g - low) <= beta * most for g in gaps) < kappa:
                bad.append(i)
        want.append((stage, len(top), len(bad)))
        mine = {i: p for i, p in mine.items() if i not in bad}
    rows = [(r.stage, r.tested, r.failed) for r in attack.outlier_leakage(o, s, n=n, k=k, closest=closest, beta=beta, kappa=kappa).collect()]
    assert rows[:3] == want and rows[3][0] == "location" and 0 < rows[3][1] <= n
    assert rows[4] == ("overall", sum(r[1] for r in rows[:4]), sum(r[2] for r in rows[:4]))


def test_porto_counter(spark):
    rows = [(0, 0.0, 0.0), (1, 0.00001, 0.0), (2, 0.001, 0.0), (3, 0.001, 0.0045), (4, 0.0020, 0.0), (5, 0.5, 0.5), (6, 0.0030, 0.0)]
    raw = spark.createDataFrame([(1, k, x, y, 1000) for k, x, y in rows], "trip long, seq long, x double, y double, start long")
    got = clean.clean_porto(raw, ["trip"], -1.0, 0.002, -1.0, 1.0, min_distance=1e-4, max_speed=30.0).orderBy("seq").collect()
    # 1 is noise, 3 and 5 are too fast and take their time, 6 is outside the box and takes none.
    assert [(r.seq, int((r.ts - datetime(1970, 1, 1)).total_seconds())) for r in got] == [(0, 1000), (2, 1030), (4, 1060)]
    wide = clean.clean_porto(raw, ["trip"], -1.0, 0.0025, -1.0, 0.0, min_distance=1e-4, max_speed=60.0).orderBy("seq").collect()
    # 3 is outside: 4 comes a step earlier.
    assert [(r.seq, int((r.ts - datetime(1970, 1, 1)).total_seconds())) for r in wide] == [(0, 1000), (2, 1030), (4, 1045)]


def test_midpoints(spark):
    g, t0 = grid.Grid(0.0, 8.0, 0.0, 8.0, 8), datetime(2009, 1, 1, 1)
    rows = [(0, 0.5, 0.5, t0), (1, 4.5, 0.5, t0 + timedelta(minutes=10)), (2, 4.5, 0.6, t0 + timedelta(hours=2)), (3, 0.5, 0.5, t0 + timedelta(hours=1))]
    p = spark.createDataFrame([("o", 1, *r) for r in rows], "dataset string, traj_id long, seq long, x double, y double, ts timestamp")
    got = grid.insert_midpoints(p, g).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(got)))
    bins = lambda t: max(math.ceil((t.hour * 3600 + t.minute * 60 + t.second) / 900) - 1, 0)
    forward = got[:-1]
    for x, y in zip(forward, forward[1:]):
        assert abs(int(x.x) - int(y.x)) <= 1 and abs(int(x.y) - int(y.y)) <= 1 and abs(bins(x.ts) - bins(y.ts)) <= 2
    assert {(r.x, r.y) for r in p.collect()} <= {(r.x, r.y) for r in got} and got[-1].x == 0.5
    assert [r.x for r in got if r.y == 0.5][:5] == [0.5, 1.5, 2.5, 3.5, 4.5]


def test_realised_points(spark):
    subs = spark.createDataFrame([(0, 0, 0, 2, 0.0), (0, 1, 1, 2, 1.0), (0, 0, 1, 2, 0.0), (0, 1, 0, 2, 0.0)], "cell int, si int, sj int, m int, share double")
    c = trips(spark, {k: [0, 7] for k in range(50)} | {99: [3]})
    got = synth.realise_points(c, a.GRID, how="adaptive", subs=subs).collect()
    assert all(50 <= r.x <= 100 and a.GRID.h / 2 <= r.y <= a.GRID.h for r in got if r.cell == 0) and len(got) == 101
    boxes = grid.uniform_grid(spark, a.GRID)
    got = synth.realise_points(c, a.GRID, how="subcell", subs=boxes).collect()
    assert Counter(r.traj_id for r in got)[99] == 2 and len(got) == 102


def test_nearest_edge_against_brute_force(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 1, size=(40, 2))
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "node_id long, lon double, lat double")
    lines = [(k, int(u), int(v), 1.0) for k, (u, v) in enumerate(rng.integers(0, 40, size=(30, 2)))]
    edges = spark.createDataFrame(lines, "edge_id long, start_node long, end_node long, length double")
    p = rng.uniform(-2, 3, size=(60, 2))
    pts = spark.createDataFrame([("o", 1, k, float(x), float(y)) for k, (x, y) in enumerate(p)], "dataset string, traj_id long, seq long, x double, y double")

    def far(q, u, v):
        t = 0 if (u == v).all() else np.clip((q - u) @ (v - u) / ((v - u) @ (v - u)), 0, 1)
        return np.hypot(*(q - (u + t * (v - u))))

    got = {r.seq: (r.node_id, r.edge_id) for r in network.nearest_road(pts, nodes, edges).collect()}
    for k, q in enumerate(p):
        assert got[k][0] == np.argmin(np.hypot(*(at - q).T)) and got[k][1] == np.argmin([far(q, at[u], at[v]) for _, u, v, _ in lines])


def test_measures_on_the_network(spark):
    from wayveil.functions.measures import matrix_measure
    from wayveil.operators import similarity

    rng = np.random.default_rng(4)
    lines = [(k, int(u), int(v), float(w)) for k, (u, v, w) in enumerate(zip(rng.integers(0, 12, 18), rng.integers(0, 12, 18), rng.integers(500, 4000, 18)))]
    edges = spark.createDataFrame(lines, "edge_id long, start_node long, end_node long, length double")
    d = np.full((12, 12), 10_000.0)
    for _, u, v, w in lines:  # a last edge wins
        d[u, v] = d[v, u] = w
    np.fill_diagonal(d, 0)
    for k in range(12):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    trips_ = {i: rng.integers(0, 12, n).tolist() for i, n in enumerate([3, 5, 1, 7, 0])}
    table = spark.createDataFrame(list(trips_.items()), "traj_id long, nodes array<long>")
    pairs = spark.createDataFrame([(i, j) for i in trips_ for j in trips_], "i long, j long")

    def edit(a, b, cost, gap):
        t = np.zeros((len(a) + 1, len(b) + 1))
        t[:, 0], t[0] = np.arange(len(a) + 1) * gap, np.arange(len(b) + 1) * gap
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = min(t[i, j] + cost(d[a[i], b[j]]), t[i, j + 1] + gap, t[i + 1, j] + gap)
        return t[-1, -1]

    for name, p, cost, gap in (("edr", {"threshold": 2000.0}, lambda x: float(x > 2000), 1.0), ("erp", {"gap": 2.0}, lambda x: x / 1000, 2.0)):
        got = {(r.i, r.j): r.score for r in similarity.score_on_network(pairs, table, table, edges, matrix_measure(name, **p)).collect()}
        assert len(got) == 25 and all(math.isclose(v, edit(trips_[i], trips_[j], cost, gap), abs_tol=1e-9) for (i, j), v in got.items())


def test_markov_walks_over_ten_thousand_cells(spark):
    """A dense matrix would have 800 MB; the moves that there are have some numbers each."""
    n = 100
    near = grid.neighbours(spark, n, with_self=False)
    matrix = near.select(F.col("cell").alias("src"), F.col("other").alias("dst"), F.lit(0.125).alias("w"))
    od = spark.createDataFrame([(0, 5050, 0.6), (77, 5050, 0.3), (9999, 3, 0.1)], "src int, dst int, p double")
    extra = spark.createDataFrame([(0, 5050, 2.0, "geometric", 9)], "src int, dst int, mean double, family string, cap int")
    got = synth.synth_grid_markov(od, extra, matrix, n, 400).orderBy("traj_id", "seq").collect()
    walks = {}
    for r in got:
        walks.setdefault(r.traj_id, []).append(r.cell)
    ends = Counter((w[0], w[-1]) for w in walks.values())
    assert len(walks) == 400 and set(ends) == {(0, 5050), (77, 5050), (9999, 3)} and ends[0, 5050] > 180
    for w in walks.values():
        assert all(max(abs(x // n - y // n), abs(x % n - y % n)) <= 1 for x, y in zip(w, w[1:]))


def test_walkers_of_a_common_end_are_dealt_over_tasks(spark, monkeypatch):
    c = trips(spark, {1: [0, 7, 14], 2: [0, 7, 14], 3: [0, 1]})
    od, extra = model.od_counts(c), model.fit_extra_lengths(c, 6)
    walk = lambda: sorted(map(tuple, synth.synth_grid_markov(od, extra, model.transitions_weighted(c, 6), 6, 300).collect()))
    one = walk()
    monkeypatch.setattr(synth, "WALKERS", 10)
    assert walk() == one


def test_adaptive_walks_over_fifty_thousand_states(spark):
    top = grid.Grid(0.0, 112.0, 0.0, 112.0, 112)
    states = spark.range(112 * 112).select(F.col("id").cast("int").alias("cell"), F.lit(2).alias("m"))
    states = adaptive.cut(adaptive.states_of(top, states))
    near = adaptive.cut(adaptive.subcell_neighbours(states))
    assert states.count() == 50_176
    moves = near.select(F.col("state").alias("src"), F.col("other").alias("dst"), F.lit(1.0).alias("w"))
    edge = states.select(F.lit(-1).alias("src"), F.col("state").alias("dst"), F.when(F.col("state") % 5000 == 7, 1.0).otherwise(0.0).alias("w"))
    stop = states.select(F.col("state").alias("src"), F.lit(-2).alias("dst"), F.lit(2.0).alias("w"))
    trips_ = spark.createDataFrame([(5007, 5019, 3.0), (10_007, 10_020, 1.0)], "src int, dst int, w double")
    paths = adaptive.cut(adaptive.state_paths(states, near, trips_))
    assert {(r.src, r.dst) for r in paths.collect()} == {(5007, 5019), (10_007, 10_020)}
    none = spark.createDataFrame([], "prev int, cur int, next int, w double")
    limits = spark.createDataFrame([], "src int, length double")
    got = adaptive.synth_adaptive(states, near, moves.union(edge).union(stop), none, trips_, paths, limits, 112, 40).collect()
    assert {r.traj_id for r in got} == set(range(40)) and {r.cell for r in got if r.seq == 0} <= set(range(7, 50_176, 5000))
