"""Nearest items in the plane: a tree of boxes over points and pieces of lines.

Items stand in the order of a curve through their boxes' middles, FANOUT of them in a leaf and FANOUT nodes in the node
above, so a crowded place has as many leaves as it needs and none holds more items. A search is a join a level: a query
meets the children of its nodes; the greatest distances to their boxes, with their counts, bound the distance of its k-th
nearest item, and nodes that begin beyond it go. Of nodes whose items all stand in one spot, equal to the bound, as many
stay as give k items: a spot with very many items costs a query no more than another.

Levels of at most SMALL nodes, a size that follows from the number of items, are sent to every task, so a query's rows stay
where they are; deeper ones are joined by shuffles, where adaptive execution splits a node that very many queries reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.tables import cut, ranked

FANOUT = 16
SMALL = 4096
_BITS = 20
#: Distances equal to so many decimals tie.
DECIMALS = 12


class BoxTree:
    """The tree over items: j, a number that orders equally near ones, and a box x0, x1, y0, y1, beside other columns; c, where
    there is one, is how many items a row stands for."""

    def __init__(self, items: DataFrame, fanout: int = FANOUT):
        items = items if "c" in items.columns else items.withColumn("c", F.lit(1).cast("long"))
        b = items.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x0", "x1", "y0", "y1") for f in (F.min, F.max)]).first()
        self.size, place = b["n"], F.lit(0).cast("long")
        for k, v in enumerate("xy"):
            low = b[f"min_{v}0"] or 0.0
            span = (b[f"max_{v}1"] or 0.0) - low or 1.0
            step = F.least(F.floor(((F.col(f"{v}0") + F.col(f"{v}1")) / 2 - low) / span * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("long")
            for bit in range(_BITS):
                place = place.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long")), 2 * bit + k))
        self.whole = max((b["max_x1"] or 0.0) - (b["min_x0"] or 0.0), (b["max_y1"] or 0.0) - (b["min_y0"] or 0.0))
        up = lambda c: F.floor(F.col(c) / fanout).cast("long")
        numbered = items.withColumn("_z", place).withColumn("_n", F.monotonically_increasing_id())
        self.members = cut(ranked(numbered, ["_z", "j", "_n"], "_r").withColumn("node", up("_r")).drop("_z", "_r", "_n"))
        sums = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("j0").alias("j0"), F.sum("c").alias("c")]
        self.levels, below, n = [], self.members.select("node", "x0", "x1", "y0", "y1", F.col("j").alias("j0"), "c"), self.size
        while True:
            n = -(-n // fanout)
            below = below.groupBy("node").agg(*sums).withColumn("parent", up("node") if n > fanout else F.lit(0).cast("long"))
            below = cut(below) if not self.levels or n > SMALL else below  # small levels follow from the one below at once
            self.levels.insert(0, (below, n))
            if n <= fanout:
                return
            below = below.drop("node").withColumnRenamed("parent", "node")

    def around(self, queries: DataFrame, k: int, tie: Column | None = None) -> DataFrame:
        """Pairs of queries (id, x, y and more) and items, among them the k nearest items of each query, with the items'
        columns; of lines in pieces k is 1. tie: orders spots at one distance, by columns of the query and the spot's x0 and y0;
        by j0 without it."""
        live, keep = queries.withColumn("_node", F.lit(0).cast("long")), [*queries.columns]
        out = lambda v: F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), F.lit(0.0))
        far = lambda v: F.greatest(F.abs(F.col(f"{v}0") - F.col(v)), F.abs(F.col(v) - F.col(f"{v}1")))
        for table, n in self.levels:
            met = live.withColumnRenamed("_node", "parent").join(F.broadcast(table) if n <= SMALL else table, "parent")
            met = met.withColumn("_lb", F.round(F.hypot(out("x"), out("y")), DECIMALS)).withColumn("_ub", F.round(F.hypot(far("x"), far("y")), DECIMALS))
            spot = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
            order = [F.col("_ub"), F.when(spot, F.col("j0").cast("double") if tie is None else tie).otherwise(float("inf")), F.col("node")]
            met = met.withColumn("_before", F.coalesce(F.sum("c").over(W.partitionBy("id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            met = met.withColumn("_bound", F.min(F.when(F.col("_before") + F.col("c") >= k, F.col("_ub"))).over(W.partitionBy("id")))
            stays = (F.col("_before") < k) | (F.col("_lb") < F.col("_bound")) | (~spot & (F.col("_lb") <= F.col("_bound")))
            live = met.where(stays).select(*keep, F.col("node").alias("_node"))
        return live.join(self.members, F.col("_node") == F.col("node")).drop("_node", "node")


def in_pieces(lines: DataFrame, whole: float, most: int = 64) -> DataFrame:
    """Lines (lon, lat, lon2, lat2 and more) as pieces with boxes, none wider than the whole / most, so at most most + 1 a line."""
    step = max(whole / most, 1e-12)
    n = F.greatest(F.ceil(F.abs(F.col("lon2") - F.col("lon")) / step), F.ceil(F.abs(F.col("lat2") - F.col("lat")) / step), F.lit(1))
    cuts = lines.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    end = lambda f, a, b: f(at(a, b, F.col("_k")), at(a, b, F.col("_k") + 1))
    boxes = {"x0": end(F.least, "lon", "lon2"), "x1": end(F.greatest, "lon", "lon2"), "y0": end(F.least, "lat", "lat2"), "y1": end(F.greatest, "lat", "lat2")}
    return cuts.withColumns(boxes).drop("_n", "_k")
