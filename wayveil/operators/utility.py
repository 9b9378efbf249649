"""How far synthetic trips are from the original ones. o and s: points or cells with traj_id."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.scalar import dist_to_segment, unit_hash
from wayveil.functions.tables import cut, ranked, with_share
from wayveil.functions.workers import ready
from wayveil.operators.grid import TRIP, assign_cell, cell_sequence, data_bounds, passes_through
from wayveil.operators.model import od_counts
from wayveil.operators.ranking import agreement

TINY = 2.0**-52


def jsd(p: DataFrame, q: DataFrame, key: list[str], w: str = "p", add: float = 0.0) -> DataFrame:
    """One row: Jensen-Shannon divergence, natural logarithm; `add` goes onto every bin that either side has."""
    both = p.select(*key, F.col(w).alias("_p")).join(q.select(*key, F.col(w).alias("_q")), key, "full").fillna(0.0, ["_p", "_q"])
    a, b = F.col("_p") + add, F.col("_q") + add
    m = (a + b) / 2
    term = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return both.agg(F.coalesce(F.sum(term(a) + term(b)) / 2, F.lit(0.0)).alias("jsd"))


def segments(pts: DataFrame) -> DataFrame:
    own = W.partitionBy(*TRIP).orderBy("seq")
    return pts.select(*TRIP, "x", "y", F.lead("x").over(own).alias("x2"), F.lead("y").over(own).alias("y2")).where("x2 is not null")


#: Queries that are sent to every task at once; more of them go block after block.
QUERY_BLOCK = 1 << 16


def touching(pts: DataFrame, queries: DataFrame, still_hits: bool = True) -> DataFrame:
    """(query_id, n): trips that touch each circle. still_hits: a step without length counts as a hit."""
    near = dist_to_segment(F.col("cx"), F.col("cy"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= F.col("r")
    still = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    return _trips_that_hit(segments(pts), queries, near | (still if still_hits else F.lit(False)))


def touching_points(pts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n): trips with a point inside each circle."""
    return _trips_that_hit(pts, queries, F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("r"))


#: Circles whose hits are the bits of one number.
_BITS = 64


def _trips_that_hit(parts: DataFrame, queries: DataFrame, hit: Column) -> DataFrame:
    """(query_id, n): trips with a part that hits the circle. The stated query set meets the parts QUERY_BLOCK rows at a time.

    A trip keeps a bit a circle, not a row, so what a task holds is a number for each _BITS circles of each of its trips.
    """
    ids = queries.select("query_id").distinct()
    blocks = max(-(-queries.count() // QUERY_BLOCK), 1)
    ids = cut(ranked(ids, ["query_id"], "_rank") if blocks > 1 else ids.withColumn("_rank", F.monotonically_increasing_id()))
    asked = queries.join(ids, "query_id").withColumn("_word", F.floor(F.col("_rank") / _BITS)).withColumn("_bit", (F.col("_rank") % _BITS).cast("int"))
    asked, parts = (cut(asked), cut(parts)) if blocks > 1 else (asked, parts)
    some = [asked.where(F.floor(F.col("_rank") / QUERY_BLOCK) == k) if blocks > 1 else asked for k in range(blocks)]
    mask = F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask")
    hits = [parts.join(F.broadcast(x.select("cx", "cy", "r", "_word", "_bit")), hit).groupBy(*TRIP, "_word").agg(mask) for x in some]  # at most QUERY_BLOCK circles
    own = F.explode(F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda k: F.getbit("_mask", k) == 1)).alias("_bit")
    counts = reduce(DataFrame.union, [x.select("_word", own).groupBy("_word", "_bit").agg(F.count("*").alias("n")) for x in hits])
    named = counts.join(ids, F.col("_rank") == F.col("_word") * _BITS + F.col("_bit")).select("query_id", "n")
    return queries.select("query_id").join(named, "query_id", "left").fillna(0, ["n"])


def query_error(o: DataFrame, s: DataFrame, queries: DataFrame, sanity: float = 0.01, points: bool = False) -> DataFrame:
    """One row: mean |s - o| / max(o, N * sanity) over the queries; a query whose denominator is 0 is left out."""
    count = touching_points if points else touching
    n = o.select(*TRIP).distinct().agg(F.count("*").alias("trips"))
    both = count(o, queries).select("query_id", F.col("n").alias("o")).join(count(s, queries).select("query_id", F.col("n").alias("s")), "query_id").crossJoin(F.broadcast(n))  # one row
    floor = F.floor(F.col("trips") * sanity) if points else F.col("trips") * sanity
    return both.agg(F.avg(F.try_divide(F.abs(F.col("s") - F.col("o")), F.greatest(F.col("o"), floor))).alias("error"))


def random_queries(spark: SparkSession, x0: float, x1: float, y0: float, y1: float, n: int, seed: int = 0, low: float = 2.5, high: float = 3.0) -> DataFrame:
    """n circles: uniform centres, radius = the larger span over 2.5 to 3."""
    u = lambda k: unit_hash(F.col("id"), F.lit(k), seed=seed)
    return spark.range(n).select(F.col("id").alias("query_id"), (x0 + u(0) * (x1 - x0)).alias("cx"), (y0 + u(1) * (y1 - y0)).alias("cy"), (max(x1 - x0, y1 - y0) / (low + u(2) * (high - low))).alias("r"))


def trip_error(o_cells: DataFrame, s_cells: DataFrame) -> DataFrame:
    return jsd(od_counts(o_cells), od_counts(s_cells), ["src", "dst"])


#: Points of a trip that are compared pair by pair.
FEW = 16


def diameter(pts: DataFrame) -> DataFrame:
    """(dataset, traj_id, d): the largest distance inside each trip; of more than FEW points, over its convex hull."""
    ready(pts.sparkSession)

    def widest(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_widest(np.column_stack([x, y])) for x, y in zip(xs, ys)], dtype=float)

    trips = pts.groupBy(*TRIP).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    apart = F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))))
    few = trips.where(F.size("p") <= FEW).select(*TRIP, F.array_max(apart).alias("d"))  # most trips: no Python
    many = trips.where(F.size("p") > FEW).select(*TRIP, F.pandas_udf(widest, "double")(F.transform("p", lambda a: a["x"]), F.transform("p", lambda a: a["y"])).alias("d"))
    return few.union(many)


def _widest(p: np.ndarray) -> float:
    p = np.unique(p, axis=0)
    hull = np.array(_chain(p) + _chain(p[::-1])) if len(p) > FEW else p
    return max((float(np.hypot(*(hull - v).T).max()) for v in hull), default=0.0)


def _chain(p: np.ndarray) -> list:
    out: list = []
    for v in p:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
            out.pop()
        out.append(v)
    return out


def path_length(pts: DataFrame) -> DataFrame:
    """(dataset, traj_id, d): length of each trip's path."""
    return pts.select(*TRIP).distinct().join(segments(pts).groupBy(*TRIP).agg(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("d")), TRIP, "left").fillna(0.0, ["d"])


def bucket_error(o: DataFrame, s: DataFrame, buckets: int, own_width: bool = False) -> DataFrame:
    """One row: divergence of `buckets` buckets of the column d, shares being of all trips of a side.

    The width is (max - min) / buckets of the original and buckets start at 0; what is above the last one goes. own_width:
    each side has its own width from its own minimum, and its maximum belongs to the last bucket.
    """
    def share(df: DataFrame, span: DataFrame) -> DataFrame:
        width = F.nullif(F.col("width"), F.lit(0.0))
        k = F.floor(F.coalesce((F.col("d") - F.col("low")) / width, F.lit(0.0)))
        k = F.least(k, F.lit(buckets - 1)) if own_width else k
        n = df.crossJoin(F.broadcast(span)).select(k.alias("bucket"), "trips").where(F.col("bucket") < buckets)  # one row
        return n.groupBy("bucket").agg((F.count("*") / F.first("trips")).alias("p"))

    def span(df: DataFrame, trips: DataFrame) -> DataFrame:
        low = F.min("d") if own_width else F.lit(0.0)
        return df.agg(((F.max("d") - F.min("d")) / buckets).alias("width"), low.alias("low")).crossJoin(trips.agg(F.count("*").alias("trips")))

    return jsd(share(o, span(o, o)), share(s, span(s if own_width else o, s)), ["bucket"])


def diameter_error(o: DataFrame, s: DataFrame, buckets: int, own_width: bool = False) -> DataFrame:
    """One row: divergence of the trips' diameters."""
    return bucket_error(diameter(o), diameter(s), buckets, own_width)


def length_error(o: DataFrame, s: DataFrame, buckets: int, own_width: bool = False) -> DataFrame:
    """One row: divergence of the trips' path lengths."""
    return bucket_error(path_length(o), path_length(s), buckets, own_width)


def utility_report(o: DataFrame, s: DataFrame, queries: DataFrame, n: int = 6, fine: int = 15, buckets: int = 20, low: int = 2, high: int = 8, top: int = 100) -> DataFrame:
    """(measure, value): how far one synthetic set is from the original, on grids over the original's box."""
    at = lambda df, side: cell_sequence(assign_cell(df, data_bounds(o, side)))
    oc, sc = cut(at(o, n)), cut(at(s, n))
    op, sp = cut(mine_patterns(oc, low, high)), mine_patterns(sc, low, high)
    best = top_patterns(op, top)
    parts = {
        "query": query_error(o, s, queries), "coverage": coverage_ranking(at(o, fine), at(s, fine), fine), "pattern_f1": pattern_f1(best, top_patterns(sp, top)),
        "pattern_support": pattern_support_error(best, sp), "trip": trip_error(oc, sc), "diameter": diameter_error(o, s, buckets), "length": length_error(o, s, buckets),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("measure"), F.col(df.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.union(row)
    return out


def mine_patterns(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(pattern, support): contiguous runs of low..high cells, counted in the map tasks first."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    grams = F.array(*[F.lead("cell", k).over(own) for k in range(high)])
    ahead = cells.select(grams.alias("g")).withColumn("g", F.filter("g", lambda x: x.isNotNull()))
    size = F.explode(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: k <= F.size("g")))
    return ahead.withColumn("k", size).select(F.slice("g", F.lit(1), F.col("k")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("support"))


def mine_cell_paths(cells: DataFrame, least: int = 3) -> DataFrame:
    """(pattern, support): whole trips as their first visits."""
    trips = cells.groupBy(*TRIP).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cell"))), lambda p: p["cell"])).alias("pattern"))
    return trips.where(F.size("pattern") >= least).groupBy("pattern").agg(F.count("*").alias("support"))


def top_patterns(patterns: DataFrame, k: int) -> DataFrame:
    """The k best by support, ties by pattern: a top-k report."""
    return patterns.orderBy(F.desc("support"), "pattern").limit(k)


def pattern_f1(o_top: DataFrame, s_top: DataFrame) -> DataFrame:
    """One row: F1 of two top sets; 0 without overlap."""
    sizes = o_top.agg(F.count("*").alias("o")).crossJoin(s_top.agg(F.count("*").alias("s"))).crossJoin(o_top.join(s_top, "pattern", "left_semi").agg(F.count("*").alias("both")))
    return sizes.select(F.coalesce(2 * F.col("both") / F.nullif(F.col("o") + F.col("s"), F.lit(0)), F.lit(0.0)).alias("f1"))


def pattern_jaccard(o_top: DataFrame, s_top: DataFrame) -> DataFrame:
    sizes = o_top.agg(F.count("*").alias("o")).crossJoin(s_top.agg(F.count("*").alias("s"))).crossJoin(o_top.join(s_top, "pattern", "left_semi").agg(F.count("*").alias("both")))
    return sizes.select(F.coalesce(F.col("both") / F.nullif(F.col("o") + F.col("s") - F.col("both"), F.lit(0)), F.lit(0.0)).alias("jaccard"))


def pattern_support_error(o_top: DataFrame, s_patterns: DataFrame) -> DataFrame:
    """One row: mean |o - s| / o over the original's top patterns, a missing one counting as 0."""
    both = o_top.withColumnRenamed("support", "o").join(s_patterns.withColumnRenamed("support", "s"), "pattern", "left").fillna(0, ["s"])
    return both.agg(F.avg(F.abs(F.col("o") - F.col("s")) / F.col("o")).alias("error"))


def pattern_ranking(o_top: DataFrame, s_patterns: DataFrame) -> DataFrame:
    """One row: Kendall tau of supports over the original's top patterns; a tie on either side counts nothing."""
    both = o_top.withColumnRenamed("support", "o").join(s_patterns.withColumnRenamed("support", "s"), "pattern", "left").fillna(0, ["s"])
    return agreement(both, "o", "s", "pattern").select(F.coalesce(F.col("score") / F.nullif(F.col("pairs"), F.lit(0)), F.lit(0.0)).alias("tau"))


def coverage_ranking(o_cells: DataFrame, s_cells: DataFrame, n: int) -> DataFrame:
    """One row: Kendall tau of trips by cell. A synthetic tie is reversed where o_i > o_j, concordant where o_i < o_j."""
    every = o_cells.sparkSession.range(n * n).select(F.col("id").cast("int").alias("cell"))
    counts = every.join(passes_through(o_cells).withColumnRenamed("trips", "o"), "cell", "left").join(passes_through(s_cells).withColumnRenamed("trips", "s"), "cell", "left").fillna(0, ["o", "s"])
    return agreement(counts, "o", "s", "cell", b_ties_by_key=True).select((F.col("score") / F.nullif(F.col("pairs"), F.lit(0))).alias("tau"))


def matrix_error(a: DataFrame, b: DataFrame, key: list[str], w: str = "n") -> DataFrame:
    """One row: L1 distance of two matrices, each scaled to sum 1."""
    share = lambda df, name: with_share(df, w, name).select(*key, name)
    return share(a, "a").join(share(b, "b"), key, "full").fillna(0.0, ["a", "b"]).agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("error"))


def bin_density(values: DataFrame, v: str, edges: list[float]) -> DataFrame:
    """(bin, share): shares in (edge, next edge], bins without values kept; the first bin has its lower edge too."""
    k = sum(((F.col(v) > e).cast("int") for e in edges[1:-1]), F.lit(0))
    spark = values.sparkSession
    counts = values.where(F.col(v).between(edges[0], edges[-1])).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    return with_share(every, "n", "share").select("bin", "share")
