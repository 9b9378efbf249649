"""Trips of each length group are worked out once."""

from wayveil.functions.measures import measure
from wayveil.operators import similarity


def test_each_side_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(r):
        seen.add(1)
        return r

    shape = "dataset string, traj_id long, pts array<long>"
    side = lambda name, odd: spark.createDataFrame(spark.sparkContext.parallelize([(name, k, [k % 7, k % 5, 3]) for k in range(odd, 60, 2)], 2).map(one), shape)
    metres = [700.0, 1000.0, 1500.0, 2500.0]
    lengths = spark.createDataFrame([("original" if k % 2 == 0 else "synthetic", k, metres[k // 2 % 4]) for k in range(60)], "dataset string, traj_id long, metres double")
    got = similarity.compare_by_length(side("original", 0), side("synthetic", 1), lengths, measure("lcrs"), 1000).collect()
    of = {k: metres[k // 2 % 4] for k in range(60)}
    want = {(g, i, j) for g, m in (("small", 700.0), ("medium", 1000.0), ("large", 2500.0)) for i in range(0, 60, 2) for j in range(1, 60, 2) if of[i] == of[j] == m}
    assert {(r.group, r.i, r.j) for r in got} == want and len(got) == len(want)
    assert seen.value == 60
