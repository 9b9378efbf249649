"""Steps around a road network: nodes (node_id, lon, lat), edges (edge_id, start_node, end_node, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.scalar import coord_key, dist_to_segment, haversine_m
from wayveil.functions.tables import cut, ranked
from wayveil.operators.boxes import DECIMALS, BoxTree, in_pieces
from wayveil.operators.grid import TRIP


def chunk_points(pts: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Adds chunk; with an overlap of 1 the point between two chunks is in both and chunks of one point go."""
    if not overlap:
        return pts.withColumn("chunk", F.floor(F.col("seq") / size).cast("int"))
    step, k = size - overlap, F.floor(F.col("seq") / (size - overlap))
    shared = (F.col("seq") % step < overlap) & (F.col("seq") >= step)
    out = pts.withColumn("chunk", F.explode(F.when(shared, F.array(k - 1, k)).otherwise(F.array(k)))).withColumn("chunk", F.col("chunk").cast("int"))
    return out.withColumn("_n", F.count("*").over(W.partitionBy(*TRIP, "chunk"))).where("_n > 1").drop("_n")


def stitch_chunks(matched: DataFrame, keep_first: bool = False, min_points: int = 2) -> DataFrame:
    """Chunks (chunk, idx) in one line again: the first point of every later chunk goes; then short trips."""
    low = W.partitionBy(*TRIP)
    kept = matched.withColumn("_c", F.min("chunk").over(low)).withColumn("_i", F.min("idx").over(W.partitionBy(*TRIP, "chunk")))
    kept = kept if keep_first else kept.where("chunk = _c or idx > _i")
    out = kept.withColumn("seq", (F.row_number().over(low.orderBy("chunk", "idx")) - 1).cast("long")).withColumn("_n", F.count("*").over(low))
    return out.where(F.col("_n") >= min_points).drop("_c", "_i", "_n", "chunk", "idx")


def interp_anchor_times(geom: DataFrame) -> DataFrame:
    """Times (epoch seconds) between known ones, linear; the last is carried on; before the first they stay null."""
    back = W.partitionBy(*TRIP).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*TRIP).orderBy("seq").rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("t").isNotNull(), F.col("seq"))
    g = geom.withColumn("_t0", F.last("t", True).over(back)).withColumn("_s0", F.last(known, True).over(back)).withColumn("_t1", F.first("t", True).over(ahead)).withColumn("_s1", F.first(known, True).over(ahead))
    between = F.col("_t0") + (F.col("_t1") - F.col("_t0")) * (F.col("seq") - F.col("_s0")) / F.nullif(F.col("_s1") - F.col("_s0"), F.lit(0))
    return g.withColumn("t", F.when(F.col("t").isNotNull(), F.col("t").cast("double")).otherwise(F.coalesce(between, F.col("_t0").cast("double")))).drop("_t0", "_s0", "_t1", "_s1")


def interp_end_times(geom: DataFrame) -> DataFrame:
    """Adds t, in whole seconds between t0 and t1 by place; t0 for a lone point or if t1 <= t0."""
    n = F.count("*").over(W.partitionBy(*TRIP))
    part = (F.col("t1") - F.col("t0")) * F.col("seq") / F.nullif(n - 1, F.lit(0))
    return geom.withColumn("t", F.when((F.col("t1") <= F.col("t0")) | (n == 1), F.col("t0").cast("double")).otherwise(F.bround(F.col("t0") + part)))


def build_registry(geom: DataFrame, existing: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, lon, lat) by rounded coordinates and directed edges (edge_id, start_node, end_node, length).

    New ids follow the order of the keys' first places. existing: (nodes, edges) that keep their ids; new ones come after.
    """
    keyed = geom.withColumn("key", coord_key(F.col("x"), F.col("y")))
    first = keyed.groupBy("key").agg(F.min(F.struct("traj_id", "seq")).alias("at"), F.min_by("x", F.struct("traj_id", "seq")).alias("lon"), F.min_by("y", F.struct("traj_id", "seq")).alias("lat"))
    nodes, next_node, next_edge = None, 0, 0
    if existing is not None:
        nodes = existing[0].select(coord_key(F.col("lon"), F.col("lat")).alias("key"), "node_id", "lon", "lat")
        first = first.join(nodes.select("key"), "key", "left_anti")
        next_node, next_edge = ((df.agg(F.max(c)).first()[0] if df is not None else None) for df, c in ((existing[0], "node_id"), (existing[1], "edge_id")))
        next_node, next_edge = (0 if x is None else x + 1 for x in (next_node, next_edge))
    fresh = ranked(first.select("key", F.col("at.traj_id").alias("_t"), F.col("at.seq").alias("_s"), "lon", "lat").withColumn("_k", F.xxhash64("key")), ["_t", "_s", "_k"], "node_id")
    fresh = fresh.select("key", (F.col("node_id") + next_node).alias("node_id"), "lon", "lat")
    nodes = cut(fresh if nodes is None else nodes.union(fresh))
    own = W.partitionBy(*TRIP).orderBy("seq")
    steps = keyed.select("traj_id", "seq", "key", F.lead("key").over(own).alias("key2")).where("key2 is not null and key != key2")
    pairs = steps.groupBy("key", "key2").agg(F.min(F.struct("traj_id", "seq")).alias("at"))
    a, b = nodes.select("key", F.col("node_id").alias("start_node"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), nodes.select(F.col("key").alias("key2"), F.col("node_id").alias("end_node"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    found = pairs.join(a, "key").join(b, "key2").select(F.col("at.traj_id").alias("_t"), F.col("at.seq").alias("_s"), "start_node", "end_node", haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("length"))
    if existing is not None:
        found = found.join(existing[1].select("start_node", "end_node"), ["start_node", "end_node"], "left_anti")
    edges = ranked(found, ["_t", "_s", "start_node", "end_node"], "edge_id").select((F.col("edge_id") + next_edge).alias("edge_id"), "start_node", "end_node", "length")
    if existing is not None:
        edges = existing[1].select("edge_id", "start_node", "end_node", "length").union(edges)
    return nodes.drop("key"), edges


def geometry_to_segments(geom: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Points of matched geometry to edge ids through the registry's coordinate keys."""
    keys = nodes.select(coord_key(F.col("lon"), F.col("lat")).alias("key"), "node_id")
    return legs_to_segments(geom.withColumn("key", coord_key(F.col("x"), F.col("y"))).join(keys, "key").select(*TRIP, "seq", "node_id"), edges)


def legs_to_segments(node_pts: DataFrame, edges: DataFrame) -> DataFrame:
    """Consecutive nodes (node_id by seq) to edge ids: no moves of zero length, no repeated ids in a row."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    legs = node_pts.select(*TRIP, "seq", F.col("node_id").alias("start_node"), F.lead("node_id").over(own).alias("end_node")).where("end_node is not null and start_node != end_node")
    ids = legs.join(edges.select("edge_id", "start_node", "end_node"), ["start_node", "end_node"])
    kept = ids.withColumn("_b", F.lag("edge_id").over(own)).where("_b is null or _b != edge_id")
    return kept.select(*TRIP, (F.row_number().over(own) - 1).cast("long").alias("order"), F.col("edge_id").alias("segment_id"), "start_node", "end_node")


def combine_segments(o: DataFrame, s: DataFrame) -> DataFrame:
    return o.withColumn("dataset", F.lit("original")).unionByName(s.withColumn("dataset", F.lit("synthetic")))


def attach_network(pts: DataFrame, segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """dataset, traj_id, seq, node_id, x, y, ts: the first start node, then all end nodes, each at the time of the point at
    the same place, or of the last one; trips without segments keep their points (node_id null)."""
    start = segs.where("`order` = 0").select(*TRIP, F.lit(0).cast("long").alias("seq"), F.col("start_node").alias("node_id"))
    rest = segs.select(*TRIP, (F.col("order") + 1).cast("long").alias("seq"), F.col("end_node").alias("node_id"))
    last = pts.groupBy(*TRIP).agg(F.max("seq").alias("_last"))
    placed = start.union(rest).join(last, TRIP, "left").withColumn("_at", F.least("seq", "_last"))
    timed = placed.join(pts.select(*TRIP, F.col("seq").alias("_at"), "ts"), [*TRIP, "_at"], "left")
    on = timed.join(nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "node_id", "left").select(*TRIP, "seq", "node_id", "x", "y", "ts")
    alone = pts.join(segs.select(*TRIP).distinct(), TRIP, "left_anti").select(*TRIP, F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("node_id"), "x", "y", "ts")
    return on.union(alone)


def downsample(pts: DataFrame, most: int = 50) -> DataFrame:
    """At most `most` points a trip, at round(i (n - 1) / (most - 1)), halves to even."""
    trips = pts.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    at = F.when(F.size("p") > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.size("p") - 1) / (most - 1)).cast("int"))).otherwise(F.sequence(F.lit(0), F.size("p") - 1))
    return trips.select(*TRIP, F.posexplode(F.transform(at, lambda i: F.element_at("p", i + 1))).alias("seq", "q")).select(*TRIP, "seq", "q.x", "q.y")


def nearest_road(pts: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Adds node_id, the nearest node, and with edges edge_id, the nearest edge (ties, also of distances equal to 12
    decimals: the smaller id). Distinct places are looked up once, in a BoxTree of nodes or of pieces of edges."""
    places = cut(pts.select("x", "y").distinct().withColumn("id", F.monotonically_increasing_id()))
    boxed = nodes.select(F.col("node_id").alias("j"), *[F.col(c).cast("double").alias(f"{v}{k}") for v, c in (("x", "lon"), ("y", "lat")) for k in "01"])
    tree = BoxTree(cut(boxed.where("x0 is not null and y0 is not null")))
    out = pts.join(_nearest(tree, places, F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")), "node_id"), ["x", "y"])
    if edges is not None:
        at = lambda k, x, y: nodes.select(F.col("node_id").alias(k), F.col("lon").alias(x), F.col("lat").alias(y))
        lines = edges.join(at("start_node", "lon", "lat"), "start_node").join(at("end_node", "lon2", "lat2"), "end_node").groupBy("lon", "lat", "lon2", "lat2").agg(F.min("edge_id").alias("j"))  # of edges along one line the smallest id is the nearest
        d = dist_to_segment(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
        out = out.join(_nearest(BoxTree(cut(in_pieces(lines, tree.whole))), places, d, "edge_id"), ["x", "y"])
    return out


def _nearest(tree: BoxTree, places: DataFrame, d, name: str) -> DataFrame:
    pairs = tree.around(places, 1)
    return pairs.groupBy("x", "y").agg(F.min(F.struct(F.round(d, DECIMALS).alias("d"), "j")).alias("m")).select("x", "y", F.col("m.j").alias(name))


def drop_repeated(pts: DataFrame, key: str) -> DataFrame:
    """Points whose key (node_id or edge_id) is not that of the point before."""
    same = F.col(key).eqNullSafe(F.lag(key).over(W.partitionBy(*TRIP).orderBy("seq"))) & (F.row_number().over(W.partitionBy(*TRIP).orderBy("seq")) > 1)
    return pts.withColumn("_same", same).where("not _same").drop("_same")


def network_distance(pairs: DataFrame, edges: DataFrame, cutoff: float = 10_000.0) -> DataFrame:
    """(a, b, d) for pairs of nodes: shortest undirected paths from distinct sources; the cutoff beyond it or without a path.

    Distances from the sources are relaxed along the edges, from the nodes that came nearer in the round before only, and
    not beyond the cutoff, until none comes nearer. A last edge wins over an earlier one of two nodes.
    """
    once = edges.groupBy(F.least("start_node", "end_node").alias("u"), F.greatest("start_node", "end_node").alias("v")).agg(F.max_by("length", "edge_id").alias("length")).where("u != v")
    links = cut(once.select("u", "v", "length").union(once.select("v", "u", "length")))
    best = cut(pairs.select(F.col("a").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("d")))
    front = best
    while front.limit(1).count():
        reached = front.join(links, front["node"] == links["u"]).select("source", F.col("v").alias("node"), (F.col("d") + F.col("length")).alias("d")).where(F.col("d") <= cutoff).groupBy("source", "node").agg(F.min("d").alias("d"))
        known = best.select("source", "node", F.col("d").alias("_was"))
        front = cut(reached.join(known, ["source", "node"], "left").where("_was is null or d < _was").select("source", "node", "d"))
        best = cut(best.join(front.select("source", "node"), ["source", "node"], "left_anti").union(front))
    found = pairs.select("a", "b").distinct().join(best.select(F.col("source").alias("a"), F.col("node").alias("b"), "d"), ["a", "b"], "left")
    return found.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("d", F.lit(cutoff))).alias("d"))
