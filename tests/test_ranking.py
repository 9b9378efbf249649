"""Agreement of two orders, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from wayveil.operators import ranking


def sign(x):
    return (x > 0) - (x < 0)


@pytest.mark.parametrize("n, values, block", [(0, 3, 4), (97, 5, 8), (300, 400, 16)])
def test_agreement_equals_all_pairs(spark, n, values, block):
    draw = random.Random(n + values)
    data = [(k, draw.randrange(values), draw.randrange(values)) for k in range(n)]
    df = spark.createDataFrame(data, "key int, a int, b int")
    pairs = [(p, q) for p in data for q in data if p[0] < q[0]]
    both = sum(sign(p[1] - q[1]) * sign(p[2] - q[2]) for p, q in pairs)
    by_key = sum(sign(p[1] - q[1]) * (sign(p[2] - q[2]) or -1) for p, q in pairs)
    assert tuple(ranking.agreement(df, "a", "b", "key").first()) == (both, len(pairs))
    assert tuple(ranking.agreement(df, "a", "b", "key", b_ties_by_key=True).first()) == (by_key, len(pairs))
    turned = sum((p[1], p[0]) < (q[1], q[0]) and (p[2], p[0]) > (q[2], q[0]) or (p[1], p[0]) > (q[1], q[0]) and (p[2], p[0]) < (q[2], q[0]) for p, q in pairs)
    assert ranking.inversions(df, ["a", "key"], ["b", "key"], block).first()[0] == turned


def test_large_orders_meet_no_pairs(spark):
    n = 200_000  # 2 * 10^10 pairs
    rows = spark.range(n).select("id", (n - F.col("id")).alias("back"))
    assert ranking.inversions(rows, ["id"], ["back"]).first()[0] == n * (n - 1) // 2
    assert ranking.inversions(rows, ["id"], ["id"]).first()[0] == 0
    plan = ranking.inversions(rows.limit(50), ["id"], ["back"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
