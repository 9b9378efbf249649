"""Rounds that must not write all pairs again, or grow with the number of trips."""

import numpy as np
from pyspark.sql import functions as F

from wayveil.operators import adaptive, attack, synth


def test_fit_moves_a_number_a_state_not_the_pairs(spark, monkeypatch):
    written = []
    real = adaptive.cut
    monkeypatch.setattr(adaptive, "cut", lambda df: (out := real(df), written.append(out.count()))[0])
    rng = np.random.default_rng(3)
    a, b, steps = rng.uniform(1, 9, 30), rng.uniform(1, 9, 30), rng.integers(1, 6, (30, 30))
    paths = spark.createDataFrame([(i, j, int(steps[i, j])) for i in range(30) for j in range(30)], "src int, dst int, steps int")
    starts = spark.createDataFrame([(i, float(w)) for i, w in enumerate(a)], "src int, w double")
    stops = spark.createDataFrame([(i, float(w)) for i, w in enumerate(b)], "dst int, w double")
    got = {(r.src, r.dst): r.w for r in adaptive.calibrate_trips(starts, stops, paths, paths, 5000.0).collect()}
    v = np.ones((30, 30))
    for _ in range(25):
        v = v * (a / v.sum(axis=1))[:, None]
        v = v * (b / v.sum(axis=0))
    w = v * steps
    w = w / w.sum() * 5000
    w = np.where(w >= 0.8, w, 0)
    w = w / w.sum() * 5000
    assert all(np.isclose(got.get((i, j), 0.0), w[i, j]) for i in range(30) for j in range(30))
    assert sum(written) < 4 * 900


def test_a_round_draws_as_many_as_the_last_one_lost(spark):
    rounds = []

    def generate(n, k, first):
        rounds.append(n)
        return spark.range(first, first + n).select(F.lit("synthetic").alias("dataset"), F.col("id").alias("traj_id"), F.when(F.xxhash64("id") % 10 == 0, 3).otherwise(7).alias("cell"))

    kept = spark.createDataFrame([("synthetic", 1, 7)], "dataset string, traj_id long, cell int")
    out = synth._refilled(kept, 500, 100, generate, [7], 50)
    assert out.count() == out.select("traj_id").distinct().count() == 501 and out.where("cell = 7").count() == 1
    assert len(rounds) <= 6


def test_points_in_one_spot_make_one_row_a_query(spark, monkeypatch):
    sizes = []
    real = attack.BoxTree
    monkeypatch.setattr(attack, "BoxTree", lambda items: sizes.append(items.count()) or real(items))
    df = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y")).union(spark.createDataFrame([(5000, 10.0, 0.0)], "id long, x double, y double"))
    got = {r.id: r.score for r in attack.knn_score_2d(df, 1500).collect()}
    assert sizes == [4] and len(got) == 3001
    assert np.isclose(got[0], 500 / 1500) and np.isclose(got[5000], (10.0 - 10.0 + 1000 * 8.0 + 499 * 9.0) / 1500)
