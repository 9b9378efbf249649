"""Search among sequences of points by dynamic time warping; between single points that is their distance.

The sequences stand in the order of a curve through their first and last points, lone points before all others, so that
their leaves' bounds are not loosened by each other's; FANOUT of them stand in a leaf and FANOUT nodes in the node above, up
to a level of FANOUT nodes. A node keeps the boxes of its sequences' first points, last points and
all points, their sizes and their smallest id; from these follow a least and a greatest distance of any query to any
sequence inside. A search is a join a level: the pairs (query, node) that a bound cannot settle meet the node's children.
Only pairs of sequences that no bound settles are compared, many at once, and given up where they pass the query's limit.
Where one of a pair is a lone point its distance is a sum, taken in Spark; Python compares the others only.
Equal sequences are one item with their number, and equal queries are asked once, so copies make no more pairs.

Levels of at most SMALL nodes, a size that follows from the number of sequences, are sent to every task; deeper ones and the
sequences meet the pairs by shuffles over a stated number of tasks. Pairs are never sent to every task: each holds its query's
points, which a file keeps once, so a small file of them can be much memory.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.measures import dtw_many
from wayveil.functions.tables import cut, ranked
from wayveil.functions.workers import ready, tasks

FANOUT = 32
#: Nodes a level that a search for a first near or far sequence follows; among single points one is enough.
LED = 16
SMALL = 4096
#: Bits of each of the four coordinates that order the sequences.
_BITS = 12
#: Bounds are sums in another order than distances; they may be off by this share.
_SLACK = 1e-9
_BOXES = [f"{box}{v}{k}" for box in "fla" for v in "xy" for k in "01"]


@functools.cache
def _dtw():
    def over(px: pd.Series, py: pd.Series, qx: pd.Series, qy: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series(dtw_many(px, py, qx, qy, limit.to_numpy()))

    return F.pandas_udf(over, "double")


def _apart(x: Column, y: Column) -> Column:
    """As dtw_many takes it, to the last bit."""
    return F.sqrt(x * x + y * y)


def distance(p: str, q: str, limit: Column | None = None) -> Column:
    """Distance of two sequences; infinite where it is above the limit."""
    side = lambda c, v: F.transform(c, lambda t: t[v].cast("double"))
    return _dtw()(side(p, "x"), side(p, "y"), side(q, "x"), side(q, "y"), F.lit(float("inf")) if limit is None else limit.cast("double"))


def _near(x: Column, y: Column, box: str) -> Column:
    out = lambda v, c: F.greatest(F.col(f"{box}{c}0") - v, v - F.col(f"{box}{c}1"), F.lit(0.0))
    return F.hypot(out(x, "x"), out(y, "y"))


def _far(x: Column, y: Column, box: str) -> Column:
    out = lambda v, c: F.greatest(F.abs(F.col(f"{box}{c}0") - v), F.abs(v - F.col(f"{box}{c}1")))
    return F.hypot(out(x, "x"), out(y, "y"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def _bounded(pairs: DataFrame) -> DataFrame:
    """Adds lb and ub: the least and greatest distance of p to any sequence of the node.

    A path of the warping meets the first points, the last points, every other point of p, and has as many steps as the
    longer sequence has points. One path follows p beside the first point and then the sequence beside p's last one.
    """
    m, first, last = F.size("p"), F.col("p")[0], F.element_at("p", -1)
    near = lambda points: F.transform(points, lambda t: _near(t["x"], t["y"], "a"))
    inner = _total(near(F.slice("p", 2, F.greatest(m - 2, F.lit(0)))))
    more = F.col("n0") - F.greatest(m, F.lit(2))
    ends = _near(first["x"], first["y"], "f"), _near(last["x"], last["y"], "l")
    low = ends[0] + ends[1] + inner + F.when(more > 0, more * F.array_min(near("p"))).otherwise(0.0)
    high = _total(F.transform("p", lambda t: _far(t["x"], t["y"], "f"))) + (F.col("n1") - 1) * _far(last["x"], last["y"], "a")
    return pairs.withColumn("lb", F.when((m == 1) & (F.col("n0") == 1), F.greatest(*ends)).otherwise(low)).withColumn("ub", high)


class SequenceTree:
    """The tree over (j, q): ids that do not repeat and arrays of points with x and y; empty ones are left out.

    Equal sequences are kept once, by their smallest id.
    """

    def __init__(self, data: DataFrame, fanout: int = FANOUT):
        self.spark, self.fanout = data.sparkSession, fanout
        ready(self.spark)
        at = lambda k, v: (F.col("q")[0] if k == "f" else F.element_at("q", -1))[v].cast("double")
        whole = lambda f, v: f(F.transform("q", lambda t: t[v].cast("double")))
        boxes = {f"{b}{v}{k}": whole(F.array_max if k == "1" else F.array_min, v) if b == "a" else at(b, v) for b in "fla" for v in "xy" for k in "01"}
        plain = F.transform("q", lambda t: F.struct(t["x"].cast("double").alias("x"), t["y"].cast("double").alias("y")))
        kinds = cut(data.where("size(q) > 0").groupBy(plain.alias("q")).agg(F.min("j").alias("j"), F.count("*").alias("c")))
        rows = kinds.select("j", "q", F.size("q").alias("n0"), F.size("q").alias("n1"), F.col("j").alias("j0"), "c", *[v.alias(k) for k, v in boxes.items()])
        ends = [f"{b}{v}0" for b in "fl" for v in "xy"]
        b = rows.agg(F.count("*").alias("n"), F.max("n1").alias("longest"), *[f(c).alias(f"{f.__name__}_{c}") for c in ends for f in (F.min, F.max)]).first()
        self.size, self.points = b["n"], b["longest"] == 1
        place = F.lit(0).cast("long")
        for k, c in enumerate(ends):
            low, span = b[f"min_{c}"] or 0.0, (b[f"max_{c}"] or 0.0) - (b[f"min_{c}"] or 0.0)
            step = F.least(F.floor((F.col(c) - low) / (span or 1.0) * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("long")
            for bit in range(_BITS):
                place = place.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long")), 4 * bit + k))
        up = lambda c: F.floor(F.col(c) / fanout).cast("long")
        self.members = cut(ranked(rows.withColumn("_z", place).withColumn("_long", F.col("n0") > 1), ["_long", "_z", "j"], "_r").withColumn("node", up("_r")).drop("_long", "_z", "_r"))
        sums = [F.min("n0").alias("n0"), F.max("n1").alias("n1"), F.min("j0").alias("j0"), F.sum("c").alias("c"), *[(F.min if c[-1] == "0" else F.max)(c).alias(c) for c in _BOXES]]
        self.levels, below, n = [], self.members, self.size
        while True:
            n = -(-n // fanout)
            below = below.groupBy("node").agg(*sums).withColumn("parent", up("node") if n > fanout else F.lit(0).cast("long"))
            below = cut(below) if not self.levels or n > SMALL else below  # small levels follow from the one below at once
            self.levels.insert(0, (below, n))
            if n <= fanout:
                return
            below = below.drop("node").withColumnRenamed("parent", "node")

    def _down(self, live: DataFrame, level: int) -> DataFrame:
        """The live pairs (…, node) with the node's children and their bounds; on the first level node is 0."""
        children, n = self.levels[level]
        live = live.withColumnRenamed("node", "parent")
        return _bounded((live.join(F.broadcast(children), "parent") if n <= SMALL else self._shuffled(live, children, "parent")).drop("parent"))

    def _shuffled(self, live: DataFrame, table: DataFrame, key: str) -> DataFrame:
        """The live pairs with the rows of the table, neither side sent whole through the driver."""
        n = tasks(self.spark)
        return live.repartition(n, key).join(table.repartition(n, key).hint("merge"), key)

    def _pairs(self, live: DataFrame) -> DataFrame:
        """The live pairs with the sequences of their leaves and bounds on each."""
        return _bounded(self._shuffled(live.select(*[c for c in live.columns if c not in {"lb", "ub", "n0", "n1", "j0", "c", *_BOXES}]), self.members, "node").drop("node"))

    def _compared(self, pairs: DataFrame, limit: Column | None = None) -> DataFrame:
        """The pairs with d, the distance of p and q. A lone point stands beside every point of the other, which takes no Python."""
        beside = lambda many, one: _total(F.transform(many, lambda t: _apart(t["x"].cast("double") - F.col(one)[0]["x"], t["y"].cast("double") - F.col(one)[0]["y"])))
        summed = pairs.withColumn("d", F.when(F.size("q") == 1, beside("p", "q")).otherwise(beside("q", "p")))
        if self.points:
            return summed
        lone = F.least(F.size("p"), F.size("q")) == 1
        return summed.where(lone).union(pairs.where(~lone).withColumn("d", distance("p", "q", limit)))

    def _once(self, queries: DataFrame, *keys: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """Queries that are equal in p and the keys asked once, and what gives their answers to all of them."""
        asks = cut(queries.groupBy("p", *keys).agg(F.min("id").alias("id")))
        back = queries.select("id", "p", *keys).join(asks.withColumnRenamed("id", "_ask"), ["p", *keys]).select("id", "_ask")
        return asks, lambda found: back.join(found.withColumnRenamed("id", "_ask"), "_ask").drop("_ask")

    def _start(self, queries: DataFrame) -> DataFrame:
        # A stated number of tasks: few bytes of queries can be much work, and adaptive execution would put them in one.
        return queries.where("size(p) > 0").repartition(tasks(self.spark), "id").withColumn("node", F.lit(0).cast("long"))

    def _led(self, queries: DataFrame, order: Column) -> DataFrame:
        """Pairs of each query with the sequences of some leaves: on each level the LED children that come first in the order."""
        live, first = self._start(queries), W.partitionBy("id").orderBy(order, "j0", "node")
        for level in range(len(self.levels)):
            placed = self._down(live, level).withColumn("_place", F.row_number().over(first))
            live = placed.where(F.col("_place") <= (1 if self.points else LED)).select("id", "p", "node")
        return self._pairs(cut(live))

    def _searched(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, d, best): a near sequence of each query; and the pairs (id, p, j, q, d, best) that can be nearer."""
        led = self._compared(self._led(queries, F.struct("lb", "ub")).select("id", "p", "j", "q"))
        found = cut(led.groupBy("id").agg(F.min(F.struct("d", "j")).alias("m")).select("id", F.col("m.d").alias("d"), F.col("m.j").alias("best")))
        low = F.col("lb") * (1 - _SLACK)
        hope = lambda j: F.struct(low, F.col(j)) < F.struct("d", "best")  # noqa: E731  the bound is worked out once
        live = self._start(queries).join(found, "id")
        for level in range(len(self.levels)):
            live = self._down(live, level).where(hope("j0")).select("id", "p", "d", "best", "node")
        live = cut(live)
        return found, self._pairs(live).where(hope("j") & (F.col("j") != F.col("best"))).select("id", "p", "j", "q", "d", "best")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """The pairs (id, j) that a search for the nearest compares beside one leaf of each of (id, p)."""
        return self._searched(queries)[1].select("id", "j")

    def nearest(self, queries: DataFrame) -> DataFrame:
        """(id, j, d): the nearest sequence to each of (id, p); of equally near ones the one with the smallest id."""
        asks, answered = self._once(queries)
        found, pairs = self._searched(asks)
        near = self._compared(pairs.select("id", "p", "j", "q", F.col("d").alias("most")), F.col("most") * (1 + _SLACK))
        every = near.select("id", "j", "d").union(found.select("id", F.col("best").alias("j"), "d"))
        return answered(every.groupBy("id").agg(F.min(F.struct("d", "j")).alias("m")).select("id", "m.j", "m.d"))

    def farthest(self, queries: DataFrame) -> DataFrame:
        """(id, d): the greatest distance of each of (id, p) to a sequence."""
        asks, answered = self._once(queries)
        led = self._compared(self._led(asks, -F.col("ub")).select("id", "p", "q"))
        found = cut(led.groupBy("id").agg(F.max("d").alias("d")))
        live = self._start(asks).join(found, "id")
        hope = F.col("ub") * (1 + _SLACK) > F.col("d")
        for level in range(len(self.levels)):
            live = self._down(live, level).where(hope).select("id", "p", "d", "node")
        more = self._compared(self._pairs(cut(live)).where(hope).select("id", "p", "q"))
        return answered(more.select("id", "d").union(found).groupBy("id").agg(F.max("d").alias("d")))

    def count_within(self, queries: DataFrame) -> DataFrame:
        """(id, n): sequences whose distance from each of (id, p, centre, reach) is at most `reach` away from `centre`."""
        out: list[DataFrame] = []
        low, high = F.col("centre") - F.col("reach"), F.col("centre") + F.col("reach")
        spare = _SLACK * (F.abs("centre") + F.abs("reach"))
        inside = (F.col("lb") * (1 - _SLACK) >= low + spare) & (F.col("ub") * (1 + _SLACK) <= high - spare)
        apart = (F.col("ub") * (1 + _SLACK) < low - spare) | (F.col("lb") * (1 - _SLACK) > high + spare)
        asks, answered = self._once(queries, "centre", "reach")
        live = self._start(asks)
        for level in range(len(self.levels)):
            met = cut(self._down(live, level).where(~apart).withColumn("_in", inside).select("id", "p", "centre", "reach", "node", "c", "_in"))
            out.append(met.where("_in").select("id", F.col("c").alias("n")))
            live = met.where("not _in").drop("_in", "c")
        near = self._compared(self._pairs(live).where(~apart).select("id", "p", "q", "centre", "reach", "c"), high + spare)
        out.append(near.where(F.abs(F.col("d") - F.col("centre")) <= F.col("reach")).select("id", F.col("c").alias("n")))
        counted = answered(functools.reduce(DataFrame.union, out).groupBy("id").agg(F.sum("n").alias("n")))
        return queries.select("id").join(counted, "id", "left").fillna(0, ["n"])
