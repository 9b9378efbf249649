"""Agreement of two orders over the same rows, without comparing rows in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.tables import cut, ranked


def inversions(df: DataFrame, first: list[str | Column], second: list[str | Column], block: int = 1 << 14) -> DataFrame:
    """One row (inversions): pairs of rows that stand one way in the first order and the other way in the second.

    No two rows may share a place in an order. Two rows part at the highest bit in which their second places differ, so
    each bit is a level: among rows that agree in the bits above, an inversion is a 1 that stands before a 0 in the first
    order. A row is sent once a level, ones are counted inside blocks of first places, and the blocks' totals are added up,
    so a window holds `block` rows, or the totals of the blocks, whatever the number of rows.
    """
    levels = max(df.count() - 1, 1).bit_length()
    places = ranked(ranked(df, first, "_i"), second, "_k").select("_i", "_k")
    at = places.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    bits = at.select("_l", F.expr("shiftright(_k, _l + 1)").alias("_g"), F.expr("shiftright(_k, _l) & 1").alias("_bit"), F.floor(F.col("_i") / block).alias("_b"), "_i")
    group, own = ["_l", "_g"], ["_l", "_g", "_b"]
    before = lambda keys, order, n: F.coalesce(F.sum(n).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = bits.withColumn("_ones", before(own, "_i", "_bit"))
    blocks = inside.groupBy(*own).agg(F.sum("_bit").alias("_n1"), F.sum(1 - F.col("_bit")).alias("_n0"), F.sum(F.when(F.col("_bit") == 0, F.col("_ones")).otherwise(0)).alias("_in"))
    return blocks.select("_in", (F.col("_n0") * before(group, "_b", "_n1")).alias("_across")).agg(F.coalesce(F.sum(F.col("_in") + F.col("_across")), F.lit(0)).alias("inversions"))


def tied_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (pairs): pairs of rows that are alike in the columns."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


def agreement(df: DataFrame, a: str, b: str, key: str, b_ties_by_key: bool = False) -> DataFrame:
    """One row (score, pairs): pairs of rows ordered alike by a and b, less those ordered oppositely, and all pairs.

    A tie in a counts nothing. A tie in b counts nothing either, or with b_ties_by_key stands in the order of the key.
    """
    rows = cut(df.select(key, a, b))
    # Rows that are alike in a, or in b where its ties count nothing, stand one way in both orders: they are no inversions.
    turned = inversions(rows, [a, b, key], [b, key] if b_ties_by_key else [b, a, key])
    every = rows.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("_all"))
    ties = tied_pairs(rows, [a]).withColumnRenamed("pairs", "_a")
    out = every.crossJoin(F.broadcast(turned)).crossJoin(F.broadcast(ties))  # one row each
    if b_ties_by_key:
        return out.select((F.col("_all") - F.col("_a") - 2 * F.col("inversions")).alias("score"), F.col("_all").alias("pairs"))
    out = out.crossJoin(F.broadcast(tied_pairs(rows, [b]).withColumnRenamed("pairs", "_b"))).crossJoin(F.broadcast(tied_pairs(rows, [a, b]).withColumnRenamed("pairs", "_ab")))
    return out.select((F.col("_all") - F.col("_a") - F.col("_b") + F.col("_ab") - 2 * F.col("inversions")).alias("score"), F.col("_all").alias("pairs"))
