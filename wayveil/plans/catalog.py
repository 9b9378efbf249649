"""All registered queries over the given tables, and their SQL. Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayveil.functions import scalar
from wayveil.functions.measures import lors, matrix_measure, measure
from wayveil.functions.tables import cut, shared_folder
from wayveil.operators import adaptive, attack, clean, grid, model, network, similarity, synth, utility
from wayveil.operators.adaptive import synth_adaptive
from wayveil.plans import adapters as a
from wayveil.sources import trajectories as io

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


def both(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("dataset = 'original'"), df.where("dataset = 'synthetic'")


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"


# Sources and coordinates.
@query("s1_s2_dat_round_trip", f"WITH {a.POINTS} SELECT traj_id, seq, round(x, 6) AS x, y, ts FROM pts")
def _(spark, d):
    path = _shared(spark)
    io.write_dat(a.points(spark, d), path, with_ts=True)
    return io.read_dat(spark, path).select("traj_id", F.col("seq").cast("long").alias("seq"), r6("x"), "y", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s3_geolife_round_trip", f"WITH {a.GPS} SELECT traj_id::VARCHAR AS \"user\", seq, round(x, 6) AS x, round(y, 6) AS y, ts FROM gps")
def _(spark, d):
    path = _shared(spark)
    io.write_geolife(a.gps(spark, d).select(F.col("traj_id").alias("user"), F.lit("Trajectory").alias("log"), "seq", "x", "y", "ts"), path)
    return io.read_geolife(spark, path, "*.txt").select("user", F.col("seq").cast("long").alias("seq"), r6("x"), r6("y"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s4_tdrive_round_trip", f"WITH {a.GPS} SELECT traj_id AS taxi, ts, round(x, 6) AS x, round(y, 6) AS y FROM gps")
def _(spark, d):
    path = _shared(spark)
    io.write_tdrive(a.gps(spark, d).withColumnRenamed("traj_id", "taxi"), path)
    return io.read_tdrive(spark, path).select("taxi", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("x"), r6("y"))


@query("s5_porto_round_trip", f"WITH {a.SHORT}, n AS (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM trips) SELECT traj_id::VARCHAR AS trip, seq, round(x, 6) AS x, y, TIMESTAMP '1970-01-01' + to_seconds(1372636800 + traj_id + 15 * seq) AS ts FROM n WHERE n >= 3 AND traj_id % 5 <> 0")
def _(spark, d):
    path, own = _shared(spark), F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("at"))))
    trips = a.short_trips(spark, d).groupBy(F.col("traj_id").alias("trip")).agg(F.transform(own, lambda p: p["at"]).alias("line"))
    io.write_porto(trips.select("trip", (F.lit(1372636800) + F.col("trip")).alias("start"), (F.col("trip") % 5 == 0).alias("missing"), "line"), path)
    return io.read_porto(spark, path).select("trip", F.col("seq").cast("long").alias("seq"), r6("x"), "y", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s6_trip_folder", f"WITH {a.GPS} SELECT traj_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM gps")
def _(spark, d):
    path = _shared(spark)
    io.write_traj_folder(a.gps(spark, d), path)
    return io.read_traj_folder(spark, path).select("traj_id", F.col("seq").cast("long").alias("seq"), r6("x"), r6("y"))


@query("s7_network_files", f"WITH {a.SHORT}, {a.EDGES} SELECT traj_id, seq AS \"order\", segment_id, e.start_node, e.end_node, round(length, 6) AS length, round(-8.7::DOUBLE + 0.03::DOUBLE * (e.start_node % 15), 6) AS lon FROM trips JOIN edges e ON edge_id = segment_id")
def _(spark, d):
    path, edges = _shared(spark), a.edges(spark, d)
    segments = a.short_trips(spark, d).join(edges.withColumnRenamed("edge_id", "segment_id"), "segment_id").select("dataset", "traj_id", F.col("seq").alias("order"), "segment_id", "start_node", "end_node")
    io.write_network(_nodes(spark), edges, segments, path)
    nodes, edges, segments = io.read_network(spark, path)
    both = segments.join(edges.select(F.col("edge_id").alias("segment_id"), "length"), "segment_id").join(nodes.withColumnRenamed("node_id", "start_node"), "start_node")
    return both.select("traj_id", F.col("order").cast("long").alias("order"), "segment_id", "start_node", "end_node", r6("length"), r6("lon"))


@query("s8_reports", f"WITH {a.POINTS} SELECT 'events' AS dataset, 'm' || (traj_id % 3) AS model, 0.5::DOUBLE AS epsilon, CAST(traj_id % 3 AS INTEGER) AS iteration, 'sniffing' AS attack, traj_id, count(*) AS n, round(max(x), 6) AS far FROM pts GROUP BY ALL")
def _(spark, d):
    path, found = _shared(spark), a.points(spark, d).groupBy("traj_id").agg(F.count("*").alias("n"), F.max("x").alias("far"))
    for k in range(3):
        io.write_report(found.where(F.col("traj_id") % 3 == k), path, "events", f"m{k}", 0.5, k, "sniffing")
    return io.read_reports(spark, path, "traj_id long, n long, far double").select("dataset", "model", "epsilon", "iteration", "attack", "traj_id", "n", r6("far"))


@query("s9_synthetic_files", f"WITH {a.POINTS} SELECT CASE traj_id % 4 WHEN 1 THEN 0.1 ELSE 1.0 END::DOUBLE AS epsilon, CAST(CASE traj_id % 4 WHEN 1 THEN 3 ELSE 7 END AS INTEGER) AS iteration, traj_id, seq, round(x, 6) AS x, y FROM pts WHERE dataset = 'synthetic'")
def _(spark, d):
    path, s = _shared(spark), both(a.points(spark, d))[1]
    for rest, name in ((1, "eps_0.1/trips-iteration3.dat"), (3, "eps_1.0/trips-iteration7.dat")):
        io.write_dat(s.where(F.col("traj_id") % 4 == rest), f"{path}/{name}")
    return io.list_synthetic(io.read_dat(spark, f"{path}/eps_*/*.dat", "synthetic")).select("epsilon", "iteration", "traj_id", F.col("seq").cast("long").alias("seq"), r6("x"), "y")


@query("p1_p2_p3_filters", f"WITH {a.GPS} SELECT traj_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM gps WHERE x BETWEEN -8.6 AND -8.2 AND y BETWEEN 41.0 AND 41.3 AND x <> 0 AND y <> 0 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-15'")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    return a.gps(spark, d).where(scalar.within_bounds(x, y, -8.6, -8.2, 41.0, 41.3) & scalar.off_null_island(x, y) & scalar.within_dates(F.col("ts"), "2024-01-05", "2024-02-15")).select("traj_id", "seq", r6("x"), r6("y"))


_HAV = "2 * 6371000 * asin(sqrt(least(pow(sin((radians(y) - radians(py)) / 2), 2) + cos(radians(py)) * cos(radians(y)) * pow(sin(radians(x - px) / 2), 2), 1)))"


@query("p4_haversine", f"WITH {a.GPS}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM gps WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)) SELECT traj_id, seq, round({_HAV}, 3) AS metres FROM s WHERE px IS NOT NULL")
def _(spark, d):
    own = model.W.partitionBy("dataset", "traj_id").orderBy("seq")
    g = a.gps(spark, d).withColumn("px", F.lag("x").over(own)).withColumn("py", F.lag("y").over(own)).where("px is not null")
    return g.select("traj_id", "seq", F.round(scalar.haversine_m(F.col("px"), F.col("py"), F.col("x"), F.col("y")), 3).alias("metres"))


@query("p5_planar_speed", f"WITH {a.GPS}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(ts) OVER w AS pt FROM gps WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)) SELECT traj_id, seq, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) * 111000 / nullif(epoch(ts) - epoch(pt), 0), 6) AS speed FROM s WHERE px IS NOT NULL")
def _(spark, d):
    own = model.W.partitionBy("dataset", "traj_id").orderBy("seq")
    g = a.gps(spark, d).withColumn("px", F.lag("x").over(own)).withColumn("py", F.lag("y").over(own)).withColumn("s", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(own))).where("px is not null")
    return g.select("traj_id", "seq", r6(scalar.planar_speed(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("s")), "speed"))


@query("p6_local_xy", f"WITH {a.GPS}, o AS (SELECT avg(x) AS lon, avg(y) AS lat FROM gps WHERE dataset = 'original') SELECT traj_id, seq, round(6371000 * radians(x - lon) * cos(radians(lat)), 3) AS east, round(6371000 * radians(y - lat), 3) AS north FROM gps, o")
def _(spark, d):
    g = a.gps(spark, d)
    east, north = scalar.to_local_xy(F.col("x"), F.col("y"), scalar.local_origin(g.where("dataset = 'original'")))
    return g.select("traj_id", "seq", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("p7_p8_utm_round_trip", f"WITH {a.GPS} SELECT traj_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM gps")
def _(spark, d):
    g = a.gps(spark, d)
    e, n = scalar.gps_to_utm(F.col("x"), F.col("y"), 29)
    g = g.withColumn("e", e).withColumn("n", n)
    lon, lat = scalar.utm_to_gps(F.col("e"), F.col("n"), 29)
    return g.select("traj_id", "seq", r6(lon, "x"), r6(lat, "y"))


@query("p9_scale", f"WITH {a.GPS} SELECT traj_id, seq, round((x + 8.78::DOUBLE) * 1000, 6) AS scaled, round(x, 6) AS back FROM gps")
def _(spark, d):
    g = a.gps(spark, d).withColumn("scaled", scalar.scale_coord(F.col("x"), -8.78, 1000.0))
    return g.select("traj_id", "seq", r6("scaled"), r6(scalar.unscale_coord(F.col("scaled"), -8.78, 1000.0), "back"))


@query("p10_p11_times", f"WITH {a.POINTS}, s AS (SELECT *, epoch(ts) - epoch(date_trunc('day', ts)) AS s FROM pts), k AS (SELECT *, CAST(floor(s / 900) AS BIGINT) AS b FROM s) SELECT traj_id, seq, CAST(greatest(CASE WHEN s = b * 900 THEN b - 1 ELSE b END, 0) AS INTEGER) AS t, TIMESTAMP '2009-01-01' + to_seconds(CAST(s AS BIGINT)) AS fixed FROM k")
def _(spark, d):
    return a.points(spark, d).select("traj_id", "seq", scalar.time_index(F.col("ts"), "00:00:00", 15).alias("t"), scalar.fix_date(F.col("ts"), "2009-01-01").cast("timestamp_ntz").alias("fixed"))


@query("p15_coord_key", f"WITH {a.GPS} SELECT CAST(round(x * 1e3) AS BIGINT) AS kx, CAST(round(y * 1e3) AS BIGINT) AS ky, count(*) AS n FROM gps GROUP BY ALL")
def _(spark, d):
    return a.gps(spark, d).groupBy(scalar.coord_key(F.col("x"), F.col("y"), 3).alias("k")).agg(F.count("*").alias("n")).select("k.kx", "k.ky", "n")


@query("p12_point_time", f"WITH {a.SHORT} SELECT traj_id, seq, TIMESTAMP '2013-07-01' + to_seconds(15 * seq) AS ts FROM trips")
def _(spark, d):
    return a.short_trips(spark, d).select("traj_id", "seq", scalar.point_time(F.lit(1_372_636_800), F.col("seq")).cast("timestamp_ntz").alias("ts"))


@query("p13_swap_and_strip", f"WITH {a.GPS} SELECT dataset, traj_id, seq, round(y, 6) AS x, round(x, 6) AS y FROM gps")
def _(spark, d):
    return scalar.strip_time(scalar.swap_lonlat(a.gps(spark, d))).select("dataset", "traj_id", "seq", r6("x"), r6("y"))


# Cleaning and selecting.
_STEP = "sqrt(pow(n.x - r.x, 2) + pow(n.y - r.y, 2))"


@query("c1_clean_split", f"WITH RECURSIVE {a.GPS}, g AS MATERIALIZED (SELECT dataset, traj_id, x, y, epoch(ts) AS t, seq, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY ts, seq) AS k FROM gps), r AS (SELECT dataset, traj_id, k, seq, x, y, t, 0 AS part, true AS kept FROM g WHERE k = 1 UNION ALL SELECT n.dataset, n.traj_id, n.k, n.seq, CASE WHEN ok THEN n.x ELSE r.x END, CASE WHEN ok THEN n.y ELSE r.y END, CASE WHEN ok THEN n.t ELSE r.t END, CASE WHEN ok AND (n.t - r.t > 43200 OR {_STEP} > 0.9::DOUBLE) THEN r.part + 1 ELSE r.part END, ok FROM (SELECT r.*, n.k AS nk, n.seq AS nseq, n.x AS nx, n.y AS ny, n.t AS nt, NOT ({_STEP} < 0.0001::DOUBLE OR (n.t - r.t > 0 AND {_STEP} * 111000 / (n.t - r.t) > 40)) AS ok FROM r JOIN g n ON n.dataset = r.dataset AND n.traj_id = r.traj_id AND n.k = r.k + 1) r, LATERAL (SELECT r.dataset, r.traj_id, r.nk AS k, r.nseq AS seq, r.nx AS x, r.ny AS y, r.nt AS t) n) SELECT traj_id, seq, part FROM r WHERE kept")
def _(spark, d):
    return clean.clean_split(a.gps(spark, d), ["dataset", "traj_id"], max_time=43_200, max_distance=0.9).select("traj_id", "seq", "part")


_FAST = f"(n.t - r.t <= 0 OR {_STEP} * 111000 / (n.t - r.t) > 40)"


@query("c2_clean_split_first", f"WITH RECURSIVE {a.GPS}, g AS MATERIALIZED (SELECT dataset, traj_id, x, y, epoch(ts) AS t, seq, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY ts, seq) AS k FROM gps), r AS (SELECT dataset, traj_id, k, seq, x, y, t, 0 AS part, true AS kept FROM g WHERE k = 1 UNION ALL SELECT dataset, traj_id, k, seq, CASE WHEN ok THEN x ELSE rx END, CASE WHEN ok THEN y ELSE ry END, CASE WHEN ok THEN t ELSE rt END, CASE WHEN ok AND t - rt > 43200 THEN part + 1 ELSE part END, ok FROM (SELECT n.dataset, n.traj_id, n.k, n.seq, n.x, n.y, n.t, r.x AS rx, r.y AS ry, r.t AS rt, r.part, {_STEP} >= 0.0001::DOUBLE AND (n.t - r.t > 43200 OR NOT {_FAST}) AS ok FROM r JOIN g n ON n.dataset = r.dataset AND n.traj_id = r.traj_id AND n.k = r.k + 1)) SELECT traj_id, seq, part FROM r WHERE kept")
def _(spark, d):
    return clean.clean_split(a.gps(spark, d), ["dataset", "traj_id"], max_time=43_200, max_distance=None, split_first=True, bad_if_no_time=True).select("traj_id", "seq", "part")


@query("c3_clean_porto", f"WITH RECURSIVE {a.GPS}, r AS (SELECT dataset, traj_id, -1::BIGINT AS seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, false AS has, 0 AS passed, 0 AS steps, false AS kept FROM gps WHERE seq = 0 UNION ALL SELECT dataset, traj_id, seq, CASE WHEN good THEN x ELSE rx END, CASE WHEN good THEN y ELSE ry END, has OR good, CASE WHEN good OR bad THEN passed + 1 ELSE passed END, passed, good FROM (SELECT *, NOT bad AND x BETWEEN -8.7 AND -8.0 AND y BETWEEN 40.95 AND 41.4 AS good FROM (SELECT n.dataset, n.traj_id, n.seq, n.x, n.y, r.x AS rx, r.y AS ry, has, passed, has AND ({_STEP} < 0.0001::DOUBLE OR {_STEP} * 111000 / 15 > 4000) AS bad FROM r JOIN gps n ON n.dataset = r.dataset AND n.traj_id = r.traj_id AND n.seq = r.seq + 1))) SELECT traj_id, seq, TIMESTAMP '1970-01-01' + to_seconds(1372636800 + 15 * steps) AS ts FROM r WHERE kept")
def _(spark, d):
    lines = a.gps(spark, d).drop("ts").withColumn("start", F.lit(1_372_636_800).cast("long"))
    return clean.clean_porto(lines, ["dataset", "traj_id"], -8.7, -8.0, 40.95, 41.4, max_speed=4000.0).select("traj_id", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("c10_cut_space_time", f"WITH {a.LOCATED}, i AS (SELECT *, x BETWEEN 50 AND 560 AND y BETWEEN 2 AND 97 AS ok FROM located), f AS (SELECT * FROM (SELECT *, min(CASE WHEN ok THEN seq END) OVER (PARTITION BY dataset, traj_id) AS f FROM i) WHERE seq >= f), n AS (SELECT *, CASE WHEN cell IS NOT DISTINCT FROM lag(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) THEN 0 ELSE 1 END AS nw FROM f), r AS (SELECT *, sum(nw) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS run FROM n), w AS (SELECT *, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY dataset, traj_id, run) AS stay FROM r), b AS (SELECT *, min(CASE WHEN NOT ok OR stay > 60000 THEN seq END) OVER (PARTITION BY dataset, traj_id) AS st FROM w) SELECT traj_id, seq FROM b WHERE st IS NULL OR seq < st")
def _(spark, d):
    inside = scalar.within_bounds(F.col("x"), F.col("y"), 50.0, 560.0, 2.0, 97.0)
    return clean.cut_space_time(a.located(spark, d), inside, 60_000).select("traj_id", "seq")


@query("c5_keep_meaningful", f"WITH {a.SHORT}, s AS (SELECT dataset, traj_id, count(*) AS n, sqrt(pow(arg_max(x, seq) - arg_min(x, seq), 2) + pow(arg_max(y, seq) - arg_min(y, seq), 2)) AS d FROM trips GROUP BY ALL) SELECT traj_id, seq, round(x, 6) AS x, y FROM trips SEMI JOIN (SELECT * FROM s WHERE n >= 3 AND d > 20) USING (dataset, traj_id)")
def _(spark, d):
    return clean.keep_meaningful(a.short_trips(spark, d), 3, 20.0).select("traj_id", "seq", r6("x"), "y")


@query("c5_keep_meaningful_path", f"WITH {a.SHORT}, p AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM trips WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)), s AS (SELECT dataset, traj_id, count(*) AS n, sum(step) AS d FROM p GROUP BY ALL) SELECT traj_id, n FROM s WHERE n >= 3 AND d > 100")
def _(spark, d):
    return clean.keep_meaningful(a.short_trips(spark, d), 3, 100.0, "path").groupBy("traj_id").agg(F.count("*").alias("n"))


@query("c6_c7_valid_trips", f"WITH {a.POINTS}, o AS (SELECT *, x < lag(x) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AND y < 20 AS bad FROM pts), v AS (SELECT DISTINCT traj_id FROM o WHERE bad AND traj_id % 3 = 0) SELECT traj_id, count(*) AS n FROM pts ANTI JOIN v USING (traj_id) GROUP BY ALL")
def _(spark, d):
    p = a.points(spark, d)
    bad = F.coalesce(F.col("x") < F.lag("x").over(model.W.partitionBy("dataset", "traj_id").orderBy("seq")), F.lit(False)) & (F.col("y") < 20) & (F.col("traj_id") % 3 == 0)
    spoilt = p.withColumn("ts", F.when(~bad, F.col("ts")))
    return clean.drop_invalid(p, clean.invalid_trips(spoilt)).groupBy("traj_id").agg(F.count("*").alias("n"))


@query("c8_drop_backwards", f"WITH {a.POINTS}, m AS (SELECT *, max(x) OVER (PARTITION BY dataset, traj_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM pts), k AS (SELECT *, count(*) OVER (PARTITION BY dataset, traj_id) AS n FROM m WHERE b IS NULL OR x > b) SELECT traj_id, seq FROM k WHERE n >= 2")
def _(spark, d):
    return clean.drop_backwards(a.points(spark, d).withColumn("ts", F.col("x"))).select("traj_id", "seq")


@query("c9_drop_repeats", f"WITH {a.LOCATED}, l AS (SELECT *, lag(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS b FROM located) SELECT traj_id, seq FROM l WHERE b IS NULL OR b <> cell")
def _(spark, d):
    p = a.located(spark, d)
    return clean.drop_repeats(p.withColumn("x", F.col("cell")).withColumn("y", F.col("cell"))).select("traj_id", "seq")


@query("c4_take_prefix", f"WITH {a.POINTS}, f AS (SELECT *, min(CASE WHEN x BETWEEN 50 AND 500 AND y BETWEEN 0 AND 95 THEN seq END) OVER (PARTITION BY dataset, traj_id) AS f FROM pts), g AS (SELECT *, epoch(ts) - epoch(date_trunc('day', ts)) AS s FROM f WHERE seq >= f), b AS (SELECT *, NOT (x BETWEEN 50 AND 500 AND y BETWEEN 0 AND 95) OR coalesce((s - lag(s) OVER (PARTITION BY dataset, traj_id ORDER BY seq) + 86400) % 86400 > 80000, false) AS br FROM g), c AS (SELECT *, min(CASE WHEN br THEN seq END) OVER (PARTITION BY dataset, traj_id) AS st FROM b), n AS (SELECT *, count(*) OVER (PARTITION BY dataset, traj_id) AS n FROM c WHERE st IS NULL OR seq < st) SELECT traj_id, seq FROM n WHERE n >= 2")
def _(spark, d):
    return clean.take_prefix(a.points(spark, d), 50, 500, 0, 95, 80_000, 2).select("traj_id", "seq")


@query("c12_c13_head_and_range", f"WITH {a.SHORT}, r AS (SELECT * FROM trips WHERE traj_id BETWEEN 100 AND 5000), i AS (SELECT traj_id, row_number() OVER (ORDER BY traj_id) - 1 AS new_id FROM (SELECT DISTINCT traj_id FROM r ORDER BY traj_id LIMIT 50)) SELECT new_id AS traj_id, seq, round(x, 6) AS x FROM r JOIN i USING (traj_id)")
def _(spark, d):
    return clean.head_trips(clean.id_range(a.short_trips(spark, d), 100, 5000), 50).select("traj_id", "seq", r6("x"))


@query("c11_sample_trips")
def _(spark, d):
    return clean.sample_trips(a.short_trips(spark, d), 100).select("traj_id", "seq")


@query("c14_reindex", f"WITH {a.SHORT}, i AS (SELECT traj_id, row_number() OVER (ORDER BY traj_id) - 1 AS new_id FROM (SELECT DISTINCT traj_id FROM trips)) SELECT new_id AS traj_id, count(*) AS n FROM trips JOIN i USING (traj_id) GROUP BY ALL")
def _(spark, d):
    return io.dense_ids(a.short_trips(spark, d)).groupBy("traj_id").agg(F.count("*").alias("n"))


@query("c15_mdl_simplify")
def _(spark, d):
    return clean.mdl_simplify(a.short_trips(spark, d).drop("segment_id")).select("traj_id", "seq")


# Grids.
@query("g1_bounds", f"WITH {a.POINTS} SELECT round(min(x), 6) AS x0, round(max(x), 6) AS x1, min(y) AS y0, max(y) AS y1 FROM pts")
def _(spark, d):
    g = grid.data_bounds(a.points(spark, d), 6)
    return spark.createDataFrame([(g.x0, g.x1, g.y0, g.y1)], "x0 double, x1 double, y0 double, y1 double").select(r6("x0"), r6("x1"), "y0", "y1")


@query("g2_uniform_grid", f"WITH {a.POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), c AS (SELECT CAST(i.range * 8 + j.range AS INTEGER) AS cell, CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j FROM range(8) i, range(8) j) SELECT cell, i, j, round(x0 + i * (x1 - x0) / 8, 6) AS x0, round(x0 + (i + 1) * (x1 - x0) / 8, 6) AS x1, round(y0 + j * (y1 - y0) / 8, 6) AS y0, round(y0 + (j + 1) * (y1 - y0) / 8, 6) AS y1 FROM c, b")
def _(spark, d):
    return grid.uniform_grid(spark, grid.data_bounds(a.points(spark, d), 8)).select("cell", "i", "j", r6("x0"), r6("x1"), r6("y0"), r6("y1"))


@query("g3_assign_cell", f"WITH {a.LOCATED} SELECT traj_id, seq, cell FROM located")
def _(spark, d):
    return a.located(spark, d).select("traj_id", "seq", "cell")


def _lower(v: str, low: float, step: float, n: int) -> str:
    return f"least(greatest(ceil(({v} - {low}) / {step}) - 1, 0), {n - 1})"


@query("g3_assign_closed_first", f"WITH {a.POINTS} SELECT traj_id, seq, CAST(CASE WHEN x BETWEEN 0 AND 500 AND y BETWEEN 0 AND 90 THEN {_lower('x', 0, 50, 10)} * 10 + {_lower('y', 0, 9, 10)} WHEN x - 0.001::DOUBLE BETWEEN 0 AND 500 AND y - 0.001::DOUBLE BETWEEN 0 AND 90 THEN {_lower('(x - 0.001::DOUBLE)', 0, 50, 10)} * 10 + {_lower('(y - 0.001::DOUBLE)', 0, 9, 10)} ELSE 0 END AS INTEGER) AS cell FROM pts")
def _(spark, d):
    return grid.assign_cell(a.points(spark, d), grid.Grid(0.0, 500.0, 0.0, 90.0, 10), "closed_first").select("traj_id", "seq", "cell")


@query("g3_assign_other_modes", f"WITH {a.POINTS} SELECT traj_id, seq, CAST(least(floor((x - 100) / 40), 9) * 10 + least(floor((y - 9) / 8), 9) AS INTEGER) AS topclamp, CAST({_lower('x', 100, 40, 10)} * 10 + {_lower('y', 9, 8, 10)} AS INTEGER) AS lower, CAST(CASE WHEN x < 100 - 1e-4 OR x > 500 + 1e-4 OR y < 9 - 1e-4 OR y > 89 + 1e-4 THEN -1 ELSE {_lower('x', 100, 40, 10)} * 10 + {_lower('y', 9, 8, 10)} END AS INTEGER) AS bins FROM pts")
def _(spark, d):
    g, p = grid.Grid(100.0, 500.0, 9.0, 89.0, 10), a.points(spark, d)
    for mode, name in (("floor_topclamp", "topclamp"), ("snap_lower", "lower"), ("bins_left", "bins")):
        p = grid.assign_cell(p, g, mode).withColumnRenamed("cell", name)
    return p.select("traj_id", "seq", "topclamp", "lower", "bins")


@query("g4_cell_sequence", f"WITH {a.CELLS} SELECT dataset, traj_id, seq, cell FROM cells")
def _(spark, d):
    return a.cells(spark, d)


@query("g5_run_lengths", f"WITH {a.LOCATED}, n AS (SELECT *, CASE WHEN cell = lag(cell) OVER w THEN 0 ELSE 1 END AS new FROM located WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)), r AS (SELECT *, sum(new) OVER (PARTITION BY dataset, traj_id ORDER BY seq) - 1 AS run FROM n) SELECT dataset, traj_id, CAST(run AS BIGINT) AS run, cell, count(*) AS length FROM r GROUP BY ALL")
def _(spark, d):
    return grid.run_lengths(a.located(spark, d))


@query("g6_fill_route", f"WITH {a.CELLS}, s AS (SELECT *, cell // 6 AS i, cell % 6 AS j, lead(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS nx FROM cells), t AS (SELECT *, coalesce(nx // 6 - i, 0) AS di, coalesce(nx % 6 - j, 0) AS dj FROM s), u AS (SELECT *, unnest(range(0, greatest(abs(di), abs(dj), 1))) AS t FROM t) SELECT dataset, traj_id, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY seq, t) - 1 AS seq, CAST((i + sign(di) * least(t, abs(di))) * 6 + j + sign(dj) * least(t, abs(dj)) AS INTEGER) AS cell FROM u")
def _(spark, d):
    return grid.fill_route(a.cells(spark, d), 6)


@query("g9_cell_visits", f"WITH {a.CELLS}, e AS (SELECT CAST(range AS INTEGER) AS cell FROM range(36)) SELECT cell, count(seq) AS visits FROM e LEFT JOIN cells USING (cell) GROUP BY ALL")
def _(spark, d):
    return grid.cell_visits(a.cells(spark, d), 6)


@query("g9_nth_densest", f"WITH {a.CELLS}, v AS (SELECT cell, count(*) AS visits FROM cells GROUP BY ALL) SELECT cell, visits, 10 AS rank FROM v ORDER BY visits DESC, cell LIMIT 1 OFFSET 9")
def _(spark, d):
    return grid.nth_densest(a.cells(spark, d), 6, 10)


@query("g10_passes_through", f"WITH {a.CELLS} SELECT cell, count(DISTINCT traj_id) AS trips FROM cells GROUP BY ALL")
def _(spark, d):
    return grid.passes_through(a.cells(spark, d))


@query("g11_density_weighted", f"WITH {a.CELLS}, n AS (SELECT *, count(*) OVER (PARTITION BY dataset, traj_id) AS n FROM cells) SELECT cell, round(sum(1.0::DOUBLE / n), 6) AS density FROM n GROUP BY ALL")
def _(spark, d):
    return grid.density_weighted(a.cells(spark, d)).select("cell", r6("density"))


@query("g12_adaptive_split", f"WITH {a.CELLS}, n AS (SELECT *, count(*) OVER (PARTITION BY dataset, traj_id) AS n FROM cells), dn AS (SELECT cell, round(sum(1.0::DOUBLE / n), 4) AS density FROM n GROUP BY ALL), m AS (SELECT cell, CAST(greatest(ceil(5 * density / 10), 1) AS INTEGER) AS m FROM dn), t AS (SELECT DISTINCT traj_id, cell, m, CAST(least(greatest(floor((x - (0.0::DOUBLE + {a.GRID.w!r}::DOUBLE * (cell // 6))) / ({a.GRID.w!r}::DOUBLE / m)), 0), m - 1) AS INTEGER) AS si, CAST(least(greatest(floor((y - (0.0::DOUBLE + {a.GRID.h!r}::DOUBLE * (cell % 6))) / ({a.GRID.h!r}::DOUBLE / m)), 0), m - 1) AS INTEGER) AS sj FROM located JOIN m USING (cell)) SELECT cell, si, sj, m, count(*) AS touching FROM t GROUP BY ALL")
def _(spark, d):
    dens = grid.density_weighted(a.cells(spark, d)).withColumn("density", F.round("density", 4))
    return grid.adaptive_split_trips(a.located(spark, d), a.GRID, dens, 10, 1.0, every=False).select("cell", "si", "sj", "m", "touching")


@query("g17_space_time_states", f"WITH {a.LOCATED}, h AS (SELECT *, CAST(extract(hour FROM ts) AS INTEGER) // 4 AS t FROM located), k AS (SELECT * FROM (SELECT *, lag(cell) OVER w AS pc, lag(t) OVER w AS pt FROM h WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)) WHERE pc IS NULL OR pc <> cell OR pt <> t) SELECT dataset, traj_id, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY seq) - 1 AS seq, cell, t, count(*) OVER (PARTITION BY dataset, traj_id) AS length FROM k")
def _(spark, d):
    return grid.space_time_states(a.located(spark, d).withColumn("t", F.floor(F.hour("ts") / 4).cast("int")))


@query("g18_density_map", f"WITH {a.LOCATED} SELECT CAST(cell // 6 AS BIGINT) AS ix, CAST(cell % 6 AS INTEGER) AS iy, count(*) AS points FROM located GROUP BY ALL")
def _(spark, d):
    return grid.density_map(a.points(spark, d), a.GRID)


@query("g20_space_time_range", f"WITH {a.POINTS}, e AS (SELECT traj_id, arg_min(ts, seq) AS f, arg_max(ts, seq) AS l FROM pts GROUP BY ALL) SELECT min(strftime(f, '%H:%M:%S')) AS start, max(strftime(l, '%H:%M:%S')) AS \"end\" FROM e")
def _(spark, d):
    return grid.space_time_range(a.points(spark, d))


# Adaptive grids.
_TOPGRID = grid.Grid(0.0, 600.0, 0.0, 100.0, 4)
#: States of a 4 x 4 top grid, split by trips: m from the density of raw points.
_STATES = f"WITH {a.POINTS}, tc AS (SELECT *, CAST({_lower('x', 0, 150, 4)} * 4 + {_lower('y', 0, 25, 4)} AS INTEGER) AS cell FROM pts), wn AS (SELECT *, count(*) OVER (PARTITION BY dataset, traj_id) AS n FROM tc), dn AS (SELECT CAST(e.range AS INTEGER) AS cell, coalesce(d, 0) AS d FROM range(16) e LEFT JOIN (SELECT cell, round(sum(1.0::DOUBLE / n), 9) AS d FROM wn GROUP BY ALL) q ON q.cell = e.range), sp AS (SELECT cell, CAST(greatest(round_even(sqrt(d * 0.8::DOUBLE), 0), 1) AS INTEGER) AS m FROM dn), sub AS (SELECT cell, m, cell // 4 AS r, cell % 4 AS c, i.range AS si, j.range AS sj FROM sp, range(64) i, range(64) j WHERE i.range < m AND j.range < m), states AS (SELECT CAST(row_number() OVER (ORDER BY cell, si, sj) - 1 AS INTEGER) AS state, *, 150.0::DOUBLE * (r + si * 1.0::DOUBLE / m) AS x0, 150.0::DOUBLE * (r + (si + 1) * 1.0::DOUBLE / m) AS x1, 25.0::DOUBLE * (c + sj * 1.0::DOUBLE / m) AS y0, 25.0::DOUBLE * (c + (sj + 1) * 1.0::DOUBLE / m) AS y1 FROM sub)"


def _states(spark, d):
    return adaptive.sqrt_states(a.points(spark, d), _TOPGRID, 0.8)


@query("g13_adaptive_states", f"{_STATES} SELECT state, cell, m, CAST(si AS INTEGER) AS si, CAST(sj AS INTEGER) AS sj, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM states")
def _(spark, d):
    return _states(spark, d).select("state", "cell", "m", "si", "sj", r6("x0"), r6("x1"), r6("y0"), r6("y1"))


@query("g13_assign_closed", f"{_STATES} SELECT traj_id, seq, state FROM pts JOIN states ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def _(spark, d):
    return adaptive.assign_states(a.points(spark, d), _TOPGRID, _states(spark, d), closed=True).select("traj_id", "seq", "state")


@query("g14_two_level", f"WITH {a.POINTS}, tc AS (SELECT *, CAST({_lower('x', 0, 150, 4)} * 4 + {_lower('y', 0, 25, 4)} AS INTEGER) AS cell FROM pts), wn AS (SELECT *, count(*) OVER (PARTITION BY dataset, traj_id) AS n FROM tc), dn AS (SELECT cell, sum(1.0::DOUBLE / n) AS d FROM wn GROUP BY ALL), t AS (SELECT count(*) AS trips FROM (SELECT DISTINCT dataset, traj_id FROM pts)) SELECT CAST(e.range AS INTEGER) AS cell, CAST(CASE WHEN d > 0.05::DOUBLE * trips / 16 THEN greatest(ceil(sqrt(d / 200)), 1) ELSE 1 END AS INTEGER) AS m FROM range(16) e LEFT JOIN dn ON dn.cell = e.range, t")
def _(spark, d):
    return adaptive.two_level_states(a.points(spark, d), _TOPGRID).select("cell", "m").distinct()


@query("g14_assign_states", f"{_STATES} SELECT traj_id, seq, state FROM pts JOIN states ON (x > x0 OR (x0 = 0 AND x >= x0)) AND x <= x1 AND (y > y0 OR (y0 = 0 AND y >= y0)) AND y <= y1")
def _(spark, d):
    return adaptive.assign_states(a.points(spark, d), _TOPGRID, _states(spark, d)).select("traj_id", "seq", "state")


_BESIDE = "near AS (SELECT DISTINCT p.state, q.state AS other FROM states p JOIN states q ON p.state <> q.state WHERE (p.cell = q.cell AND abs(p.si - q.si) + abs(p.sj - q.sj) = 1) OR (p.r + 1 = q.r AND p.c = q.c AND p.si = p.m - 1 AND q.si = 0) OR (p.r - 1 = q.r AND p.c = q.c AND p.si = 0 AND q.si = q.m - 1) OR (p.r = q.r AND p.c + 1 = q.c AND p.sj = p.m - 1 AND q.sj = 0) OR (p.r = q.r AND p.c - 1 = q.c AND p.sj = 0 AND q.sj = q.m - 1))"


@query("g15_subcell_neighbours", f"{_STATES}, {_BESIDE} SELECT state, other FROM near")
def _(spark, d):
    return adaptive.subcell_neighbours(_states(spark, d))


@query("g16_insert_midpoints")
def _(spark, d):
    return grid.insert_midpoints(a.points(spark, d), a.GRID).select("traj_id", "seq", r6("x"), r6("y"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("g19_ranked_bounds", f"WITH {a.POINTS}, t AS (SELECT dataset, traj_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY ALL), b1 AS (SELECT min(x0) AS a0, max(x1) AS a1, min(y0) AS a2, max(y1) AS a3 FROM t), t1 AS (SELECT t.*, x0 = a0 OR x1 = a1 OR y0 = a2 OR y1 = a3 AS hit FROM t, b1), b2 AS (SELECT min(x0) AS a0, max(x1) AS a1, min(y0) AS a2, max(y1) AS a3 FROM t1 WHERE NOT hit) SELECT traj_id, 1 AS rank FROM t1 WHERE hit UNION ALL SELECT traj_id, 2 FROM t1, b2 WHERE NOT hit AND (x0 = a0 OR x1 = a1 OR y0 = a2 OR y1 = a3)")
def _(spark, d):
    return grid.ranked_bounds(a.points(spark, d), 2)[1].select("traj_id", "rank")


@query("g21_subcells_in_box", f"{_STATES} SELECT state FROM states WHERE x0 <= 320 AND x1 >= 140 AND y0 <= 60 AND y1 >= 20")
def _(spark, d):
    return grid.subcells_in_box(_states(spark, d), 140.0, 320.0, 20.0, 60.0).select("state")


# Models.
@query("a1_od_counts", f"WITH {a.ENDS} SELECT src, dst, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS p FROM ends GROUP BY src, dst")
def _(spark, d):
    return model.od_counts(a.cells(spark, d)).select("src", "dst", "n", r6("p"))


@query("a2_transitions", f"WITH {a.MOVES} SELECT src, dst, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS p FROM moves GROUP BY src, dst")
def _(spark, d):
    return model.transitions(a.cells(spark, d)).select("src", "dst", "n", r6("p"))


_FULL = ", f AS (SELECT i.range AS src, j.range AS dst FROM range(36) i, range(36) j), w AS (SELECT src, dst, sum(1.0::DOUBLE / (length - 1)) AS w FROM moves GROUP BY ALL), g AS (SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, coalesce(w, 0) AS w FROM f LEFT JOIN w USING (src, dst))"


@query("a3_transitions_weighted", f"WITH {a.MOVES}{_FULL} SELECT src, dst, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY src), 0), 0), 6) AS w FROM g")
def _(spark, d):
    return model.transitions_weighted(a.cells(spark, d), 6, adjacent_only=False).select("src", "dst", r6("w"))


@query("a4_start_end", f"WITH {a.CELLS}, b AS (SELECT *, 1.0::DOUBLE / (count(*) OVER (PARTITION BY dataset, traj_id) + 1) AS w, lead(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS nx FROM cells), u AS (SELECT cell AS src, coalesce(nx, -2) AS dst, w FROM b UNION ALL SELECT -1, cell, w FROM b WHERE seq = 0) SELECT src, dst, round(sum(w), 6) AS w FROM u GROUP BY ALL")
def _(spark, d):
    return model.transitions_start_end(a.cells(spark, d)).select("src", "dst", r6("w"))


_SE = f"{a.CELLS}, se_b AS (SELECT *, 1.0::DOUBLE / (count(*) OVER (PARTITION BY dataset, traj_id) + 1) AS w, lead(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS nx FROM cells), se_u AS (SELECT cell AS src, coalesce(nx, -2) AS dst, w FROM se_b UNION ALL SELECT -1, cell, w FROM se_b WHERE seq = 0), se AS (SELECT src, dst, sum(w) AS w FROM se_u GROUP BY ALL)"
_SENSITIVE = f"{_SE}, st AS (SELECT DISTINCT cell FROM cells), rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM se WHERE src >= 0 AND dst >= 0), cl AS (SELECT src AS cell FROM rk WHERE r <= 2 GROUP BY src HAVING count(*) = 2 AND min(w) > 0 AND max(w) / min(w) < 5), mv AS (SELECT src AS cell, sum(w) AS w FROM se WHERE src >= 0 AND dst >= 0 GROUP BY src), ou AS (SELECT src AS cell, sum(w) AS w FROM se GROUP BY src), sensitive AS (SELECT st.cell FROM st LEFT JOIN cl USING (cell) LEFT JOIN mv USING (cell) LEFT JOIN ou USING (cell) LEFT JOIN (SELECT dst AS cell, w FROM se WHERE src = -1) s USING (cell) LEFT JOIN (SELECT src AS cell, w FROM se WHERE dst = -2) e USING (cell), (SELECT count(*) AS n FROM st) n WHERE (cl.cell IS NOT NULL AND coalesce(mv.w, 0) > n.n * 1.414::DOUBLE / (5.0::DOUBLE * 0.6::DOUBLE)) OR coalesce(ou.w, 0) > 0.02::DOUBLE * (SELECT sum(w) FROM se) OR coalesce(s.w, 0) > 0.02::DOUBLE * (SELECT sum(w) FROM se WHERE src = -1 AND dst >= 0) OR coalesce(e.w, 0) > 0.02::DOUBLE * (SELECT sum(w) FROM se WHERE dst = -2 AND src >= 0))"


@query("a5_sensitive_states", f"WITH {_SENSITIVE} SELECT cell FROM sensitive")
def _(spark, d):
    return model.sensitive_states(model.transitions_start_end(a.cells(spark, d)), 5.0)


@query("a5_a6_second_order_sensitive", f"WITH {_SENSITIVE}, t AS (SELECT coalesce(lag(cell) OVER w, -1) AS prev, cell AS cur, coalesce(lead(cell) OVER w, -2) AS next, 1.0::DOUBLE / count(*) OVER (PARTITION BY dataset, traj_id) AS w FROM cells WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)), o AS (SELECT prev, cur, next, sum(w) AS w FROM t SEMI JOIN sensitive ON t.cur = sensitive.cell GROUP BY ALL), x AS (SELECT *, sum(CASE WHEN next = -2 THEN w ELSE 0 END) OVER (PARTITION BY cur) AS two FROM o) SELECT prev, cur, next, round(x.w * CASE WHEN next = -2 AND two > 0 THEN 1.5::DOUBLE * coalesce(se.w, 0) / two ELSE 1 END, 6) AS w FROM x LEFT JOIN (SELECT * FROM se WHERE dst = -2) se ON se.src = x.cur")
def _(spark, d):
    c = a.cells(spark, d)
    first = model.transitions_start_end(c)
    return model.second_order(c, model.sensitive_states(first, 5.0), first).select("prev", "cur", "next", r6("w"))


@query("a6_noisy_second_order")
def _(spark, d):
    c = a.cells(spark, d)
    first = model.transitions_start_end(c, 2.0)
    return model.second_order(c, model.sensitive_states(first, 5.0), first, 1.0)


def _fine(spark, d):
    return grid.cell_sequence(grid.assign_cell(a.points(spark, d), grid.Grid(0.0, 600.0, 0.0, 100.0, 40)))


def _edge_neighbours(spark, n: int):
    """Cells that share an edge, from the states of a grid without splits."""
    g = grid.Grid(0.0, 600.0, 0.0, 100.0, n)
    states = adaptive.states_of(g, grid.uniform_grid(spark, g).select("cell", F.lit(1).alias("m")))
    return adaptive.subcell_neighbours(states).select(F.col("state").alias("cell"), "other")


_GROWN = f"WITH {a.POINTS}, lo AS (SELECT *, CAST(least(greatest(floor(x / 15), 0), 39) * 40 + least(greatest(floor(y / 2.5::DOUBLE), 0), 39) AS INTEGER) AS cell FROM pts), kp AS (SELECT *, lag(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS b FROM lo), cl AS (SELECT dataset, traj_id, seq, cell FROM kp WHERE b IS NULL OR b <> cell), m0 AS (SELECT DISTINCT cell AS src, nx AS dst FROM (SELECT cell, lead(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS nx FROM cl) WHERE nx IS NOT NULL), ids AS (SELECT CAST(range AS INTEGER) AS c FROM range(1600)), nb AS (SELECT p.c AS cell, q.c AS other FROM ids p JOIN ids q ON q.c IN (p.c - 40, p.c + 40, CASE WHEN p.c % 40 > 0 THEN p.c - 1 END, CASE WHEN p.c % 40 < 39 THEN p.c + 1 END)), m1 AS (SELECT * FROM m0 UNION SELECT nb.other, m0.dst FROM m0 JOIN nb ON nb.cell = m0.src UNION SELECT m0.src, nb.other FROM m0 JOIN nb ON nb.cell = m0.dst) SELECT * FROM m1 UNION SELECT nb.other, m1.dst FROM m1 JOIN nb ON nb.cell = m1.src UNION SELECT m1.src, nb.other FROM m1 JOIN nb ON nb.cell = m1.dst"


@query("a9_two_step_mask", _GROWN)
def _(spark, d):
    return model.two_step_mask(model.transitions(_fine(spark, d)), _edge_neighbours(spark, 40))


@query("a10_length_thresholds", f"WITH {a.ENDS}, w AS (SELECT src, dst, count(*) AS w FROM ends GROUP BY ALL), t AS (SELECT src, sum((abs(src // 6 - dst // 6) + abs(src % 6 - dst % 6) + 1 + 6) * w) * 1.0::DOUBLE / sum(w) AS length FROM w GROUP BY ALL) SELECT CAST(e.range AS INTEGER) AS src, round(coalesce(length, -1), 6) AS length FROM range(36) e LEFT JOIN t ON t.src = e.range")
def _(spark, d):
    coarse = grid.uniform_grid(spark, a.GRID).select("cell", F.col("i").alias("row"), F.col("j").alias("col"))
    return model.length_thresholds(model.od_counts(a.cells(spark, d)).withColumnRenamed("n", "w"), coarse, 36).select("src", r6("length"))


@query("a11_extra_lengths", f"WITH {a.ENDS} SELECT src, dst, CAST(length - (greatest(abs(src // 6 - dst // 6), abs(src % 6 - dst % 6), 1) + 1) AS BIGINT) AS extra, count(*) AS trips FROM ends GROUP BY ALL")
def _(spark, d):
    return model.extra_lengths(a.cells(spark, d), 6)


@query("a11_fit_extra_lengths")
def _(spark, d):
    return model.fit_extra_lengths(a.cells(spark, d), 6)


_ST = f"WITH {a.LOCATED}, h AS (SELECT *, CAST(extract(hour FROM ts) AS INTEGER) // 4 AS t FROM located), k AS (SELECT * FROM (SELECT *, lag(cell) OVER w AS pc, lag(t) OVER w AS pt FROM h WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)) WHERE pc IS NULL OR pc <> cell OR pt <> t), st AS (SELECT dataset, traj_id, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY seq) - 1 AS seq, cell, t, count(*) OVER (PARTITION BY dataset, traj_id) AS length FROM k)"


def _space_time(spark, d):
    return grid.space_time_states(a.located(spark, d).withColumn("t", F.floor(F.hour("ts") / 4).cast("int")))


@query("a12_start_counts", f"{_ST}, dom AS (SELECT CAST(c.range AS INTEGER) AS cell, CAST(t.range AS INTEGER) AS t FROM range(36) c, range(6) t), n AS (SELECT dom.cell, dom.t, count(st.seq) AS n FROM dom LEFT JOIN st ON st.cell = dom.cell AND st.t = dom.t AND st.seq = 0 GROUP BY ALL), p AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER () AS p FROM n), tr AS (SELECT 100 + range AS total FROM range(217)), ok AS (SELECT max(total) AS total FROM (SELECT total, sum(floor(total * p)) AS f FROM p, tr GROUP BY total) WHERE f <= 100) SELECT cell, t, CAST(n AS DOUBLE) AS n, CAST(floor(total * p) AS BIGINT) AS whole FROM p, ok")
def _(spark, d):
    domain = spark.range(216).select(F.floor(F.col("id") / 6).cast("int").alias("cell"), (F.col("id") % 6).cast("int").alias("t"))
    return model.scale_counts(model.start_counts(_space_time(spark, d), domain), 100).select("cell", "t", "n", "whole")


@query("a13_space_time_transitions", f"{_ST}, mv AS (SELECT cell, t, lead(cell) OVER w AS cell2, lead(t) OVER w AS t2, 1.0::DOUBLE / length AS w FROM st WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)), sn AS (SELECT cell, t, cell2, t2, sum(w) AS w FROM mv WHERE cell2 IS NOT NULL GROUP BY ALL), dom AS (SELECT CAST(p.range AS INTEGER) AS cell, CAST(q.range AS INTEGER) AS cell2, CAST(t.range AS INTEGER) AS t, CAST(t.range + s.range AS INTEGER) AS t2 FROM range(36) p, range(36) q, range(6) t, range(3) s WHERE abs(p.range // 6 - q.range // 6) <= 1 AND abs(p.range % 6 - q.range % 6) <= 1 AND t.range + s.range < 6 AND CASE WHEN p.range = q.range THEN s.range >= 1 ELSE s.range <= 1 END) SELECT cell, t, cell2, t2, round(coalesce(coalesce(w, 0) / nullif(sum(coalesce(w, 0)) OVER (PARTITION BY cell, t), 0), 0), 6) AS w FROM dom LEFT JOIN sn USING (cell, t, cell2, t2)")
def _(spark, d):
    return model.space_time_transitions(_space_time(spark, d), 6, 6).select("cell", "t", "cell2", "t2", r6("w"))


def _adaptive_model(p, top=_TOPGRID, beta: float = 0.8):
    """States, their neighbours, the trips' states, first-order moves, paths and calibrated trips, without noise."""
    states = adaptive.sqrt_states(p, top, beta)
    near, walked = cut(adaptive.subcell_neighbours(states)), grid.cell_sequence(adaptive.assign_states(p, top, states).withColumnRenamed("state", "cell"))
    walked = cut(walked)
    first = cut(model.transitions_start_end(walked))
    starts, stops = first.where("src = -1 and dst >= 0").select(F.col("dst").alias("src"), "w"), first.where("dst = -2 and src >= 0").select(F.col("src").alias("dst"), "w")
    # Paths of the pairs that trips may go between, a row a start.
    moves = first.where("src >= 0 and dst >= 0").select("src", "dst")
    wanted = adaptive.allowed_ends(moves, near, starts.where("w > 0"), stops.where("w > 0"))
    rows = cut(adaptive.state_paths(states, near, wanted, arrays=True))
    trips = adaptive.calibrate_rows(starts, stops, rows, p.select("traj_id").distinct().count())
    paths = rows.select("src", F.explode(F.arrays_zip("dst", "steps")).alias("_p")).select("src", "_p.dst", "_p.steps")
    return states, near, walked, first, paths, trips


@query("a7_calibrate_trips")
def _(spark, d):
    return _adaptive_model(a.short_trips(spark, d), grid.Grid(0.0, 110.0, 0.0, 51.0, 4), 0.01)[5].select("src", "dst", r6("w"))


@query("a8_state_paths")
def _(spark, d):
    states = _states(spark, d)
    return adaptive.state_paths(states, adaptive.subcell_neighbours(states))


@query("a14_markov_power", f"WITH {a.MOVES}{_FULL}, p AS (SELECT src, dst, coalesce(w / nullif(sum(w) OVER (PARTITION BY src), 0), 0) AS w FROM g), p2 AS (SELECT x.src, y.dst, sum(x.w * y.w) AS w FROM p x JOIN p y ON x.dst = y.src WHERE x.w > 0 AND y.w > 0 GROUP BY ALL), p3 AS (SELECT x.src, y.dst, sum(x.w * y.w) AS w FROM p2 x JOIN p y ON x.dst = y.src WHERE y.w > 0 GROUP BY ALL) SELECT src, dst, round(w, 6) AS w FROM p3")
def _(spark, d):
    return model.markov_power(model.transitions_weighted(a.cells(spark, d), 6, adjacent_only=False), 3).select("src", "dst", r6("w"))


@query("a15_prefix_next", f"WITH {a.CELLS}, t AS (SELECT traj_id, list(cell ORDER BY seq) AS c FROM cells GROUP BY ALL) SELECT c[2] AS next, count(*) AS trips FROM t WHERE c[1] = 2 GROUP BY ALL")
def _(spark, d):
    return model.prefix_next(a.cells(spark, d), [2])


@query("n2_row_normalise", f"WITH {a.MOVES}, n AS (SELECT src, dst, count(*) AS n FROM moves GROUP BY ALL) SELECT src, dst, round(n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY src), 6) AS w FROM n")
def _(spark, d):
    t = model.transitions(a.cells(spark, d)).select("src", "dst", F.col("n").cast("double").alias("w"))
    return model.row_normalise(t, ["src"]).select("src", "dst", r6("w"))


@query("n3_queue_minus", f"WITH {a.MOVES}, n AS (SELECT src, dst, count(*) - 12.0::DOUBLE AS w FROM moves GROUP BY ALL), c AS (SELECT *, -sum(least(w, 0)) OVER (PARTITION BY src) AS neg, sum(greatest(w, 0)) OVER (PARTITION BY src ORDER BY greatest(w, 0), dst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM n) SELECT src, dst, greatest(0.0, least(cum - neg, greatest(w, 0))) AS w FROM c")
def _(spark, d):
    t = model.transitions(a.cells(spark, d)).select("src", "dst", (F.col("n") - 12.0).alias("w"))
    return model.queue_minus(t, ["src"])


@query("n1_noisy_transitions")
def _(spark, d):
    return model.transitions_weighted(a.cells(spark, d), 6, eps=1.0).select("src", "dst", r6("w"))


@query("n5_median_length", f"WITH {a.ENDS}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY length, dataset, traj_id) - 1 AS r, count(*) OVER (PARTITION BY src, dst) AS n FROM ends WHERE length >= 2), b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY abs(r - n / 2.0::DOUBLE), r) AS k FROM r) SELECT src, dst, greatest(length, 2) AS length FROM b WHERE k = 1")
def _(spark, d):
    return model.dp_median_length(a.cells(spark, d), None)


@query("n4_n5_noisy_median_length")
def _(spark, d):
    return model.dp_median_length(a.cells(spark, d), 1.0)


# Synthesis.
@query("y1_synth_grid_markov")
def _(spark, d):
    c = a.cells(spark, d)
    return synth.synth_grid_markov(model.od_counts(c), model.fit_extra_lengths(c, 6), model.transitions_weighted(c, 6), 6, c.select("traj_id").distinct().count())


@query("y2_synth_median_length")
def _(spark, d):
    c = a.cells(spark, d)
    return synth.synth_median_length(model.od_counts(c), model.dp_median_length(c, None), model.transitions_weighted(c, 6, adjacent_only=False), 6, c.select("traj_id").distinct().count())


@query("y3_synth_adaptive")
def _(spark, d):
    states, near, walked, first, paths, trips = _adaptive_model(a.points(spark, d))
    second = model.second_order(walked, model.sensitive_states(first, 5.0), first)
    limits = model.length_thresholds(trips, states.select(F.col("state").alias("cell"), "row", "col"), _TOPGRID.n**2)
    # The trips of the table leap over top cells at most moves, so walks that may not do so come from the moves between neighbours.
    place = states.select("state", "row", "col")
    steps = first.where("src >= 0 and dst >= 0").join(place.toDF("src", "r1", "c1"), "src").join(place.toDF("dst", "r2", "c2"), "dst").where("abs(r1 - r2) + abs(c1 - c2) <= 1").select("src", "dst", "w")
    legal = steps.union(first.where("src < 0 or dst < 0").select("src", "dst", "w"))
    return synth_adaptive(states, near, legal, second.join(steps.select(F.col("src").alias("cur"), F.col("dst").alias("next")), ["cur", "next"]), trips, paths, limits, _TOPGRID.n, walked.select("traj_id").distinct().count())


@query("y4_synth_count_split")
def _(spark, d):
    c = a.cells(spark, d)
    m = model.transitions_start_end(c)
    share = model.row_normalise(m, ["src"])
    starts = c.where("seq = 0").groupBy("cell").agg(F.count("*").alias("n"))
    return synth.synth_count_split(starts, share.where("src >= 0 and dst >= 0").select("src", "dst", F.col("w").alias("p")))


@query("y5_realise_points")
def _(spark, d):
    return synth.realise_points(a.cells(spark, d), a.GRID).select("traj_id", "seq", "cell", "x", "y")


@query("y5_realise_centres", f"{_ST} SELECT traj_id, seq, round(100.0::DOUBLE * (cell // 6 + 0.5::DOUBLE), 6) AS x, round({a.GRID.h!r}::DOUBLE * (cell % 6 + 0.5::DOUBLE), 6) AS y, TIMESTAMP '2009-01-01' + to_seconds(CAST((t + 0.5) * 14400 AS BIGINT)) AS ts FROM st")
def _(spark, d):
    out = synth.realise_points(_space_time(spark, d), a.GRID, how="centre", step_min=240.0)
    return out.select("traj_id", "seq", r6("x"), r6("y"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("y5_realise_in_subcells")
def _(spark, d):
    trips = a.points(spark, d).select("traj_id").distinct().count()
    subs = grid.adaptive_split_trips(a.located(spark, d), a.GRID, grid.density_weighted(a.cells(spark, d)), trips, 1.0, every=False)
    return synth.realise_points(a.cells(spark, d), a.GRID, how="adaptive", subs=subs).select("traj_id", "seq", "cell", "x", "y")


def _generator(spark, d):
    """(count, round, first id) -> cells of new trips, from the original trips' model."""
    c = cut(a.cells(spark, d).where("dataset = 'original'"))
    od, extra, matrix = cut(model.od_counts(c)), cut(model.fit_extra_lengths(c, 6)), cut(model.transitions_weighted(c, 6))
    return lambda n, k, first: synth.synth_grid_markov(od, extra, matrix, 6, n, seed=k + 1, first_id=first)


@query("y6_defend_bayesian")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    return synth.defend_bayesian(o, s, 8, 0.55, _generator(spark, d))


@query("y7_defend_sniffing")
def _(spark, d):
    o, s = both(a.located(spark, d).select("dataset", "traj_id", "seq", "x", "y", "cell"))
    new = _generator(spark, d)
    points = lambda n, k, first: synth.realise_points(new(n, k, first), a.GRID, seed=k).select("dataset", "traj_id", "seq", "x", "y", "cell")
    return synth.defend_sniffing(o, s, 20, 1, points, rounds=1000)


@query("y8_defend_outliers")
def _(spark, d):
    o, s = both(a.located(spark, d).select("dataset", "traj_id", "seq", "x", "y", "cell"))
    new = _generator(spark, d)
    points = lambda n, k, first: synth.realise_points(new(n, k, first), a.GRID, seed=k).select("dataset", "traj_id", "seq", "x", "y", "cell")
    return synth.defend_outliers(o, s, points)


# Utility.
def _jsd(o: str, s: str, key: str, add: str = "") -> str:
    p, q = f"(coalesce(o.p, 0){add})", f"(coalesce(s.p, 0){add})"
    return f"SELECT round(sum(CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM {o} o FULL JOIN {s} s USING ({key})"


def _share(name: str, source: str, where: str, key: str) -> str:
    return f", {name} AS (SELECT {key}, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM {source} WHERE {where} GROUP BY {key})"


@query("u1_jsd_transitions", f"WITH {a.MOVES}{_share('o_', 'moves', chr(39).join(['dataset = ', 'original', '']), 'src, dst')}{_share('s_', 'moves', chr(39).join(['dataset = ', 'synthetic', '']), 'src, dst')} {_jsd('o_', 's_', 'src, dst')}")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    return utility.jsd(model.transitions(o), model.transitions(s), ["src", "dst"]).select(r6("jsd"))


@query("u5_trip_error", f"WITH {a.ENDS}{_share('o_', 'ends', chr(39).join(['dataset = ', 'original', '']), 'src, dst')}{_share('s_', 'ends', chr(39).join(['dataset = ', 'synthetic', '']), 'src, dst')} {_jsd('o_', 's_', 'src, dst')}")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    return utility.trip_error(o, s).select(r6("jsd"))


_SEG = ", seg AS (SELECT * FROM (SELECT dataset, traj_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)) WHERE x2 IS NOT NULL), cl AS (SELECT *, CASE WHEN (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) = 0 THEN 0 ELSE least(greatest(((cx - x) * (x2 - x) + (cy - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0), 1) END AS t FROM seg, circles), hit AS (SELECT dataset, query_id, count(DISTINCT traj_id) AS n FROM cl WHERE sqrt(pow(cx - (x + t * (x2 - x)), 2) + pow(cy - (y + t * (y2 - y)), 2)) <= r OR (x = x2 AND y = y2) GROUP BY ALL)"


@query("u2_query_error", f"WITH {a.POINTS}, {a.CIRCLES}{_SEG} SELECT round(avg(abs(coalesce(s.n, 0) - coalesce(o.n, 0)) / greatest(coalesce(o.n, 0), t.trips * 0.01::DOUBLE)), 6) AS error FROM circles c LEFT JOIN (SELECT * FROM hit WHERE dataset = 'original') o USING (query_id) LEFT JOIN (SELECT * FROM hit WHERE dataset = 'synthetic') s USING (query_id), (SELECT count(DISTINCT traj_id) AS trips FROM pts WHERE dataset = 'original') t")
def _(spark, d):
    o, s = both(a.points(spark, d))
    return utility.query_error(o, s, a.circles(spark, d)).select(r6("error"))


@query("u3_query_error_points", f"WITH {a.POINTS}, {a.CIRCLES}, hit AS (SELECT dataset, query_id, count(DISTINCT traj_id) AS n FROM pts, circles WHERE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) <= r GROUP BY ALL) SELECT round(avg(abs(coalesce(s.n, 0) - coalesce(o.n, 0)) * 1.0::DOUBLE / nullif(greatest(coalesce(o.n, 0), floor(t.trips * 0.01::DOUBLE)), 0)), 6) AS error FROM circles c LEFT JOIN (SELECT * FROM hit WHERE dataset = 'original') o USING (query_id) LEFT JOIN (SELECT * FROM hit WHERE dataset = 'synthetic') s USING (query_id), (SELECT count(DISTINCT traj_id) AS trips FROM pts WHERE dataset = 'original') t")
def _(spark, d):
    o, s = both(a.points(spark, d))
    return utility.query_error(o, s, a.circles(spark, d), points=True).select(r6("error"))


@query("u6_diameter", f"WITH {a.SHORT} SELECT p.traj_id, round(max(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6) AS d FROM trips p JOIN trips q USING (dataset, traj_id) GROUP BY p.traj_id")
def _(spark, d):
    return utility.diameter(a.short_trips(spark, d)).select("traj_id", r6("d"))


_LEN = ", len AS (SELECT dataset, traj_id, coalesce(sum(step), 0) AS d FROM (SELECT dataset, traj_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM trips WINDOW w AS (PARTITION BY dataset, traj_id ORDER BY seq)) GROUP BY ALL)"
_BUCKETS = ", wd AS (SELECT (max(d) - min(d)) / 20 AS width FROM len WHERE dataset = 'original'), tr AS (SELECT dataset, count(*) AS trips FROM len GROUP BY ALL), bk AS (SELECT dataset, floor(d / width) AS bucket, trips FROM len JOIN tr USING (dataset), wd WHERE floor(d / width) < 20), o_ AS (SELECT bucket, count(*) * 1.0::DOUBLE / any_value(trips) AS p FROM bk WHERE dataset = 'original' GROUP BY ALL), s_ AS (SELECT bucket, count(*) * 1.0::DOUBLE / any_value(trips) AS p FROM bk WHERE dataset = 'synthetic' GROUP BY ALL)"
_OWN = ", wd AS (SELECT dataset, (max(d) - min(d)) / 20 AS width, min(d) AS low, count(*) AS trips FROM len GROUP BY ALL), bk AS (SELECT dataset, least(floor((d - low) / width), 19) AS bucket, trips FROM len JOIN wd USING (dataset)), o_ AS (SELECT bucket, count(*) * 1.0::DOUBLE / any_value(trips) AS p FROM bk WHERE dataset = 'original' GROUP BY ALL), s_ AS (SELECT bucket, count(*) * 1.0::DOUBLE / any_value(trips) AS p FROM bk WHERE dataset = 'synthetic' GROUP BY ALL)"
_DIA = ", len AS (SELECT p.dataset, p.traj_id, max(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS d FROM trips p JOIN trips q USING (dataset, traj_id) GROUP BY ALL)"


@query("u8_length_error", f"WITH {a.SHORT}{_LEN}{_BUCKETS} {_jsd('o_', 's_', 'bucket')}")
def _(spark, d):
    return utility.length_error(*both(a.short_trips(spark, d)), 20).select(r6("jsd"))


@query("u7_diameter_error", f"WITH {a.SHORT}{_DIA}{_BUCKETS} {_jsd('o_', 's_', 'bucket')}")
def _(spark, d):
    return utility.diameter_error(*both(a.short_trips(spark, d)), 20).select(r6("jsd"))


@query("u7_diameter_error_own_width", f"WITH {a.SHORT}{_DIA}{_OWN} {_jsd('o_', 's_', 'bucket')}")
def _(spark, d):
    return utility.diameter_error(*both(a.short_trips(spark, d)), 20, own_width=True).select(r6("jsd"))


@query("u17_utility_report")
def _(spark, d):
    o, s = both(a.points(spark, d))
    return utility.utility_report(o, s, a.circles(spark, d)).select("measure", r6("value"))


@query("u10_cell_paths", f"WITH {a.SHORT}, lo AS (SELECT dataset, traj_id, seq, CAST(least(greatest(floor(x / 100), 0), 5) * 6 + least(greatest(floor(y / 100 * 6), 0), 5) AS INTEGER) AS cell FROM trips), f AS (SELECT traj_id, cell, min(seq) AS fst FROM lo GROUP BY ALL), p AS (SELECT traj_id, string_agg(cell, ',' ORDER BY fst) AS pattern, count(*) AS n FROM f GROUP BY ALL) SELECT pattern, count(*) AS support FROM p WHERE n >= 3 GROUP BY ALL")
def _(spark, d):
    located = grid.assign_cell(a.short_trips(spark, d), a.GRID)
    return utility.mine_cell_paths(located).select(F.array_join("pattern", ",").alias("pattern"), "support")


_GRAM = ", lists AS (SELECT dataset, traj_id, list(cell ORDER BY seq) AS c FROM cells GROUP BY ALL), gram AS (SELECT dataset, c[i:i + k - 1] AS pattern FROM (SELECT dataset, c, k, unnest(range(1, len(c) - k + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS k FROM lists))), sup AS (SELECT dataset, array_to_string(pattern, ',') AS pattern, count(*) AS support FROM gram GROUP BY ALL)"


@query("u9_mine_patterns", f"WITH {a.CELLS}{_GRAM} SELECT dataset, pattern, support FROM sup")
def _(spark, d):
    out = [utility.mine_patterns(x, 2, 4).select(F.lit(n).alias("dataset"), F.array_join("pattern", ",").alias("pattern"), "support") for n, x in zip(("original", "synthetic"), both(a.cells(spark, d)))]
    return out[0].union(out[1])


def _patterns(spark, d):
    return [utility.mine_patterns(x, 2, 4).withColumn("pattern", F.array_join("pattern", ",")) for x in both(a.cells(spark, d))]


_TOP = ", ot AS (SELECT pattern, support FROM sup WHERE dataset = 'original' ORDER BY support DESC, pattern LIMIT 100), st AS (SELECT pattern, support FROM sup WHERE dataset = 'synthetic' ORDER BY support DESC, pattern LIMIT 100), sa AS (SELECT pattern, support FROM sup WHERE dataset = 'synthetic')"


@query("u11_top_patterns", f"WITH {a.CELLS}{_GRAM}{_TOP} SELECT * FROM ot")
def _(spark, d):
    return utility.top_patterns(_patterns(spark, d)[0], 100)


@query("u12_pattern_f1", f"WITH {a.CELLS}{_GRAM}{_TOP} SELECT round(2.0::DOUBLE * (SELECT count(*) FROM ot SEMI JOIN st USING (pattern)) / ((SELECT count(*) FROM ot) + (SELECT count(*) FROM st)), 6) AS f1")
def _(spark, d):
    o, s = (utility.top_patterns(x, 100) for x in _patterns(spark, d))
    return utility.pattern_f1(o, s).select(r6("f1"))


@query("u13_pattern_jaccard", f"WITH {a.CELLS}{_GRAM}{_TOP}, b AS (SELECT count(*) AS b FROM ot SEMI JOIN st USING (pattern)) SELECT round(b * 1.0::DOUBLE / ((SELECT count(*) FROM ot) + (SELECT count(*) FROM st) - b), 6) AS jaccard FROM b")
def _(spark, d):
    o, s = (utility.top_patterns(x, 100) for x in _patterns(spark, d))
    return utility.pattern_jaccard(o, s).select(r6("jaccard"))


@query("u14_pattern_support_error", f"WITH {a.CELLS}{_GRAM}{_TOP} SELECT round(avg(abs(ot.support - coalesce(sa.support, 0)) * 1.0::DOUBLE / ot.support), 6) AS error FROM ot LEFT JOIN sa USING (pattern)")
def _(spark, d):
    o, s = _patterns(spark, d)
    return utility.pattern_support_error(utility.top_patterns(o, 100), s).select(r6("error"))


@query("u15_pattern_ranking", f"WITH {a.CELLS}{_GRAM}{_TOP}, j AS (SELECT ot.pattern, ot.support AS o, coalesce(sa.support, 0) AS s FROM ot LEFT JOIN sa USING (pattern)) SELECT round(sum(sign(p.o - q.o) * sign(p.s - q.s)) * 1.0::DOUBLE / count(*), 6) AS tau FROM j p JOIN j q ON p.pattern < q.pattern")
def _(spark, d):
    o, s = _patterns(spark, d)
    return utility.pattern_ranking(utility.top_patterns(o, 100), s).select(r6("tau"))


@query("u16_coverage_ranking", f"WITH {a.CELLS}, c AS (SELECT e.range AS cell, count(DISTINCT CASE WHEN dataset = 'original' THEN traj_id END) AS o, count(DISTINCT CASE WHEN dataset = 'synthetic' THEN traj_id END) AS s FROM range(36) e LEFT JOIN cells ON cells.cell = e.range GROUP BY ALL) SELECT round(sum(CASE WHEN (p.o > q.o AND p.s > q.s) OR (p.o < q.o AND p.s <= q.s) THEN 1 WHEN p.o <> q.o THEN -1 ELSE 0 END) * 1.0::DOUBLE / count(*), 6) AS tau FROM c p JOIN c q ON p.cell < q.cell")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    return utility.coverage_ranking(o, s, 6).select(r6("tau"))


@query("u18_matrix_error", f"WITH {a.MOVES}{_share('o_', 'moves', chr(39).join(['dataset = ', 'original', '']), 'src, dst')}{_share('s_', 'moves', chr(39).join(['dataset = ', 'synthetic', '']), 'src, dst')} SELECT round(sum(abs(coalesce(o.p, 0) - coalesce(s.p, 0))), 6) AS error FROM o_ o FULL JOIN s_ s USING (src, dst)")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    return utility.matrix_error(model.transitions(o), model.transitions(s), ["src", "dst"]).select(r6("error"))


@query("u19_bin_density", f"WITH {a.POINTS}, b AS (SELECT CAST((x > 100)::INTEGER + (x > 200)::INTEGER + (x > 400)::INTEGER AS INTEGER) AS bin, count(*) AS n FROM pts WHERE x BETWEEN 0 AND 600 GROUP BY ALL) SELECT CAST(e.range AS INTEGER) AS bin, round(coalesce(n, 0) * 1.0::DOUBLE / sum(n) OVER (), 6) AS share FROM range(4) e LEFT JOIN b ON b.bin = e.range")
def _(spark, d):
    return utility.bin_density(a.points(spark, d), "x", [0.0, 100.0, 200.0, 400.0, 600.0]).select("bin", r6("share"))


# Attacks.
@query("k1_region_frames")
def _(spark, d):
    return attack.region_frames(a.points(spark, d), 8, 12)


@query("k2_reidentification_all_known", f"WITH {a.POINTS}, n AS (SELECT dataset, traj_id, count(*) AS n FROM pts GROUP BY ALL), b AS (SELECT *, unnest(range(12)) AS bin FROM n), f AS (SELECT b.dataset, b.traj_id, bin, least(greatest(floor(x / 300), 0), 1) * 2 + least(greatest(floor(y / 50), 0), 1) AS region FROM b JOIN pts p ON p.traj_id = b.traj_id AND p.seq = bin * (n - 1) // 11), m AS (SELECT o.traj_id AS u, s.traj_id AS w, sum((o.region = s.region)::INTEGER) / 12.0::DOUBLE AS rate FROM f o JOIN f s ON o.bin = s.bin WHERE o.dataset = 'original' AND s.dataset = 'synthetic' GROUP BY ALL), t AS (SELECT *, max(rate) OVER (PARTITION BY u) AS best FROM m), v AS (SELECT u, rate, bin, region, count(*) AS n FROM t JOIN f ON f.traj_id = t.w WHERE rate = best AND rate > 0.5 GROUP BY ALL), g AS (SELECT u, rate, bin, arg_max(region, n * 10 - region) AS guess FROM v GROUP BY ALL), h AS (SELECT g.u, rate, avg((guess = region)::INTEGER) AS found FROM g JOIN f ON f.traj_id = g.u AND f.bin = g.bin GROUP BY ALL) SELECT o.traj_id AS \"user\", round(coalesce(rate, 0), 6) AS rate, round(coalesce(found, 0), 6) AS found FROM (SELECT DISTINCT traj_id FROM f WHERE dataset = 'original') o LEFT JOIN h ON h.u = o.traj_id")
def _(spark, d):
    frames = attack.sampled_bins(a.points(spark, d), 12)
    return attack.reidentification(grid.assign_cell(frames, grid.Grid(0.0, 600.0, 0.0, 100.0, 2)).select("dataset", "traj_id", "bin", F.col("cell").alias("region")), 12, 0.5).select("user", r6("rate"), r6("found"))


@query("k2_reidentification")
def _(spark, d):
    frames = attack.sampled_bins(a.points(spark, d), 12)
    return attack.reidentification(grid.assign_cell(frames, grid.Grid(0.0, 600.0, 0.0, 100.0, 2)).select("dataset", "traj_id", "bin", F.col("cell").alias("region")), 3, 0.5).select("user", r6("rate"), r6("found"))


@query("k1_sampled_bins", f"WITH {a.POINTS}, n AS (SELECT dataset, traj_id, count(*) AS n FROM pts GROUP BY ALL), b AS (SELECT *, unnest(range(12)) AS bin FROM n) SELECT b.dataset, b.traj_id, CAST(bin AS INTEGER) AS bin, round(x, 6) AS x, y FROM b JOIN pts p ON p.traj_id = b.traj_id AND p.seq = bin * (n - 1) // 11")
def _(spark, d):
    return attack.sampled_bins(a.points(spark, d), 12).select("dataset", "traj_id", "bin", r6("x"), "y")


_ZONE = f"WITH {a.MOVES}, th AS (SELECT DISTINCT traj_id FROM cells WHERE dataset = 'synthetic' AND cell = 8), eo AS (SELECT traj_id, arg_min(cell, seq) AS src, arg_max(cell, seq) AS dst FROM cells WHERE dataset = 'original' GROUP BY ALL), es AS (SELECT traj_id, arg_min(cell, seq) AS src, arg_max(cell, seq) AS dst FROM cells SEMI JOIN th USING (traj_id) GROUP BY ALL), mo AS (SELECT src, dst FROM moves WHERE dataset = 'original'), ms AS (SELECT src, dst FROM moves SEMI JOIN th USING (traj_id)){_share('o_', 'eo', 'true', 'src, dst')}{_share('s_', 'es', 'true', 'src, dst')}{_share('om', 'mo', 'true', 'src, dst')}{_share('sm', 'ms', 'true', 'src, dst')}"
_EPS = " + 2.220446049250313e-16"


@query("k3_bayesian_attack", f"{_ZONE}, a1 AS ({_jsd('o_', 's_', 'src, dst', _EPS)}), a2 AS ({_jsd('om', 'sm', 'src, dst', _EPS)}) SELECT round(a1.jsd, 4) AS start_end, round(a2.jsd, 4) AS moves, round((a1.jsd + a2.jsd) / 2, 3) AS risk, (SELECT count(*) FROM th) = 0 OR (a1.jsd <= 0.5 AND a2.jsd <= 0.5) AS passes FROM a1, a2")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    out = attack.bayesian_attack(o, s, 8)
    return out.select(F.round("start_end", 4).alias("start_end"), F.round("moves", 4).alias("moves"), F.round("risk", 3).alias("risk"), "passes")


@query("k3_bayesian_risk")
def _(spark, d):
    o, s = both(a.cells(spark, d))
    return attack.bayesian_attack(o, s, 8)


def _dp(keys: str, rows: str, start: str, step: str, last: str) -> str:
    """CTEs pr, w and scored (keys, d) of a table walked anti-diagonal by anti-diagonal, one list a pair.

    rows: SELECT of keys and the arrays a and b. start, step: the list of anti-diagonal 0 and the value at (i, k - i) of
    anti-diagonal k; d1 and d2 are the two before it. last: the condition of the last one, whose last place is the result.
    """
    used = ", ".join(f"w.{x.strip()}" for x in keys.split(","))
    return f"""pr AS (SELECT *, len(a) AS m, len(b) AS n FROM ({rows}) WHERE len(a) > 0 AND len(b) > 0),
 w({keys}, k, d1, d2) USING KEY ({keys}) AS (SELECT {keys}, 0, {start}, {start} FROM pr
 UNION SELECT {used}, w.k + 1, [{step} FOR i IN range(len(w.d1))], w.d1 FROM w JOIN pr USING ({keys}) WHERE NOT ({last})),
 scored AS (SELECT {keys}, d1[len(d1)] AS d FROM w JOIN pr USING ({keys}) WHERE {last})"""


_INF = "'inf'::DOUBLE"
_DTW_COST = "sqrt(pow(a[{i}].x - b[{j}].x, 2) + pow(a[{i}].y - b[{j}].y, 2))"


def _dtw(keys: str, rows: str) -> str:
    start = f"[CASE WHEN z = 0 THEN {_DTW_COST.format(i='1', j='1')} ELSE {_INF} END FOR z IN range(m)]"
    first = f"CASE WHEN w.k = 0 AND i >= 0 THEN {_INF} ELSE w.d2[i] END"
    step = f"CASE WHEN w.k + 1 - i BETWEEN 0 AND n - 1 THEN {_DTW_COST.format(i='i + 1', j='w.k + 2 - i')} + least(w.d1[i + 1], w.d1[i], {first}) ELSE {_INF} END"
    return _dp(keys, rows, start, step, "k = m + n - 2")


_ROUTES = "rt AS (SELECT *, cell // 6 AS i, cell % 6 AS j, lead(cell) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS nx FROM cells), rd AS (SELECT *, coalesce(nx // 6 - i, 0) AS di, coalesce(nx % 6 - j, 0) AS dj FROM rt), ru AS (SELECT *, unnest(range(0, greatest(abs(di), abs(dj), 1))) AS t FROM rd), route AS (SELECT dataset, traj_id, CAST((i + sign(di) * least(t, abs(di))) * 6 + j + sign(dj) * least(t, abs(dj)) AS INTEGER) AS cell FROM ru)"
_SNIFF = f"""WITH RECURSIVE {a.CELLS}, {_ROUTES}, rk AS (SELECT CAST(range AS INTEGER) AS cell, row_number() OVER (ORDER BY coalesce(v, 0) DESC, range) AS rank FROM range(36) LEFT JOIN (SELECT cell, count(*) AS v FROM route WHERE dataset = 'original' GROUP BY ALL) ON cell = range),
 sn AS (SELECT cell AS sc FROM rk WHERE rank = 12), se AS (SELECT cell AS ec FROM rk WHERE rank = 10), f1 AS (SELECT *, min(CASE WHEN cell = sc THEN seq END) OVER (PARTITION BY dataset, traj_id) AS f FROM located, sn), f2 AS (SELECT *, min(CASE WHEN cell <> sc AND seq > f THEN seq END) OVER (PARTITION BY dataset, traj_id) AS e FROM f1),
 part AS (SELECT dataset, traj_id, list({{'x': x, 'y': y}} ORDER BY seq) AS p FROM f2 WHERE seq >= f AND (e IS NULL OR seq < e) GROUP BY ALL),
 {_dtw("oid, sid", "SELECT o.traj_id AS oid, s.traj_id AS sid, o.p AS a, s.p AS b FROM part o, part s WHERE o.dataset = 'original' AND s.dataset = 'synthetic'")},
 best AS (SELECT oid, arg_min(sid, (d, sid)) AS sid, min(d) AS d FROM scored GROUP BY ALL),
 met AS (SELECT best.*, (SELECT count(*) FROM pts p WHERE p.traj_id = oid AND EXISTS (SELECT 1 FROM pts q WHERE q.traj_id = best.sid AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) < 10)) AS n, sid IN (SELECT traj_id FROM route, se WHERE dataset = 'synthetic' AND cell = ec) AS visits FROM best)"""


@query("k4_partial_sniffing", f"{_SNIFF} SELECT oid AS i, sid AS j, round(d, 6) AS dtw, n, visits, n >= 5 OR visits AS fails FROM met")
def _(spark, d):
    p = cut(a.located(spark, d))
    o, s = both(p)
    routes = cut(grid.fill_route(grid.cell_sequence(o), 6))
    sniff, sensitive = (grid.nth_densest(routes, 6, rank).first().cell for rank in (12, 10))
    return attack.partial_sniffing(o, s, sniff, sensitive, 5, 10.0, 6).select("i", "j", r6("dtw"), "n", "visits", "fails")


@query("k4_sniffing_risk", f"{_SNIFF} SELECT sc AS sniff_cell, ec AS sensitive_cell, (SELECT count(DISTINCT traj_id) FROM route, sn WHERE dataset = 'original' AND cell = sn.sc) AS sniffed, count(oid) AS matched, (count(CASE WHEN n >= 5 THEN 1 END) + count(CASE WHEN visits THEN 1 END))::BIGINT AS events, count(CASE WHEN n >= 5 THEN 1 END) AS by_points, count(CASE WHEN visits THEN 1 END) AS by_cell, count(DISTINCT CASE WHEN n >= 5 OR visits THEN sid END) AS failing, round(count(DISTINCT CASE WHEN n >= 5 OR visits THEN sid END) * 1.0::DOUBLE / (SELECT count(DISTINCT traj_id) FROM pts WHERE dataset = 'synthetic'), 6) AS risk FROM sn, se LEFT JOIN met ON true GROUP BY sc, ec")
def _(spark, d):
    o, s = both(a.points(spark, d))
    out = attack.sniffing_risk(o, s, a.GRID, tol=10.0)
    return out.withColumn("risk", F.round("risk", 6))


@query("k5_first_segment", f"WITH {a.LOCATED}, f AS (SELECT *, min(CASE WHEN cell = 8 THEN seq END) OVER (PARTITION BY dataset, traj_id) AS f FROM located), e AS (SELECT *, min(CASE WHEN cell <> 8 AND seq > f THEN seq END) OVER (PARTITION BY dataset, traj_id) AS e FROM f) SELECT traj_id, seq FROM e WHERE seq >= f AND (e IS NULL OR seq < e)")
def _(spark, d):
    return attack.first_segment_in_cell(a.located(spark, d), 8).select("traj_id", "seq")


@query("k6_intersections", f"WITH {a.POINTS}, pr AS (SELECT DISTINCT traj_id AS i, traj_id + 1 AS j FROM pts WHERE traj_id % 2 = 0) SELECT i, j, count(DISTINCT CASE WHEN sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) < 10 THEN q.seq END) AS n FROM pr LEFT JOIN pts p ON p.traj_id = i LEFT JOIN pts q ON q.traj_id = j GROUP BY ALL")
def _(spark, d):
    o, s = both(a.points(spark, d))
    pairs = o.select(F.col("traj_id").alias("i"), (F.col("traj_id") + 1).alias("j")).distinct()
    return attack.intersection_count(pairs, o, s, 10.0)


def _vectors(spark, d):
    return a.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("k7_knn_2d", "WITH v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), d AS (SELECT p.id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS r FROM v p, v q) SELECT id, round(avg(d), 6) AS score FROM d WHERE r <= 5 GROUP BY ALL")
def _(spark, d):
    return attack.knn_score_2d(_vectors(spark, d), 5).select("id", r6("score"))


@query("k7_knn_1d", "WITH v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x FROM embeddings), d AS (SELECT p.id, abs(p.x - q.x) AS d, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.x - q.x)) AS r FROM v p, v q) SELECT id, round(avg(d), 6) AS score FROM d WHERE r <= 5 GROUP BY ALL")
def _(spark, d):
    return attack.knn_score_1d(_vectors(spark, d).select("id", F.col("x").alias("v")), 5).select("id", r6("score"))


@query("k9_plausible_deniability", f"WITH {a.POINTS}, f AS (SELECT dataset, traj_id AS id, arg_min(x, seq) AS x, arg_min(y, seq) AS y FROM pts GROUP BY ALL), d AS (SELECT s.id, sqrt((s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y)) AS d FROM f s, f o WHERE s.dataset = 'synthetic' AND o.dataset = 'original'), m AS (SELECT *, min(d) OVER (PARTITION BY id) AS nearest FROM d) SELECT id, round(nearest, 6) AS nearest, sum((abs(d - nearest) <= 0.1::DOUBLE * 500)::INTEGER)::BIGINT AS plausible, nearest > 0.05::DOUBLE * 500 OR sum((abs(d - nearest) <= 0.1::DOUBLE * 500)::INTEGER) >= 3 AS passes FROM m GROUP BY id, nearest")
def _(spark, d):
    f = a.points(spark, d).groupBy("dataset", F.col("traj_id").alias("id")).agg(F.array(F.min_by("x", "seq"), F.min_by("y", "seq")).alias("v"))
    o, s = both(f)
    return attack.plausible_deniability(s.select("id", "v"), o.select("v"), 500.0).select("id", r6("nearest"), "plausible", "passes")


@query("k10_rare_cells", f"WITH {a.CELLS}, s AS (SELECT * FROM cells WHERE dataset = 'synthetic'), v AS (SELECT cell, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT cell, n, sum((n > 20)::INTEGER) OVER (ORDER BY n DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM v) SELECT DISTINCT dataset, traj_id FROM s SEMI JOIN (SELECT cell FROM f WHERE coalesce(over, 0) = 0) USING (cell) ORDER BY traj_id LIMIT 20")
def _(spark, d):
    return attack.rare_cell_candidates(a.cells(spark, d).where("dataset = 'synthetic'"), 20)


@query("k8_top_outliers", "WITH d AS (SELECT p.vec_id AS id, abs(p.embedding[1]::DOUBLE - q.embedding[1]::DOUBLE) AS d, row_number() OVER (PARTITION BY p.vec_id ORDER BY abs(p.embedding[1]::DOUBLE - q.embedding[1]::DOUBLE)) AS r FROM embeddings p, embeddings q), s AS (SELECT id, round(avg(d), 6) AS score FROM d WHERE r <= 5 GROUP BY ALL) SELECT min(id) OVER (PARTITION BY score) AS id, score FROM s ORDER BY score DESC, s.id LIMIT 50")
def _(spark, d):
    scores = attack.knn_score_1d(_vectors(spark, d).select("id", F.col("x").alias("v")), 5).select("id", r6("score"))
    return attack.top_outliers(scores, 50)


_FAR = "s.id, sqrt(pow(s.x - o.x, 2) + pow(s.y - o.y, 2)) AS d"


@query("k9_length_deniability", f"WITH {a.SHORT}{_LEN}, c AS (SELECT traj_id AS id, d FROM len WHERE dataset = 'synthetic' ORDER BY d DESC, traj_id LIMIT 50), o AS (SELECT d FROM len WHERE dataset = 'original'), sp AS (SELECT max(d) - min(d) AS most FROM o), p AS (SELECT c.id, o.d - c.d AS d, abs(o.d - c.d) AS gap FROM c, o), n AS (SELECT id, min(d) AS nearest FROM p GROUP BY ALL) SELECT id, round(nearest, 6) AS nearest, sum((abs(gap - nearest) <= 0.05::DOUBLE * most)::INTEGER)::BIGINT AS plausible, nearest > 0.1::DOUBLE * any_value(most) OR sum((abs(gap - nearest) <= 0.05::DOUBLE * most)::INTEGER) >= 100 AS passes FROM p JOIN n USING (id), sp GROUP BY id, nearest")
def _(spark, d):
    o, s = both(utility.path_length(a.short_trips(spark, d)))
    cands = s.orderBy(F.desc("d"), "traj_id").limit(50).select(F.col("traj_id").alias("id"), F.col("d").alias("v"))
    span = o.agg(F.max("d") - F.min("d")).first()[0]
    return attack.plausible_deniability(cands, o.select(F.col("d").alias("v")), span, "length", 0.1, 0.05, 100, signed=True).select("id", r6("nearest"), "plausible", "passes")


@query("k9_dtw_deniability", f"""WITH RECURSIVE {a.SHORT}, tr AS (SELECT dataset, traj_id, list({{'x': x, 'y': y}} ORDER BY seq) AS p FROM trips GROUP BY ALL),
 cand AS (SELECT traj_id AS id, p FROM tr WHERE dataset = 'synthetic' ORDER BY traj_id LIMIT 20), {_dtw("id, oid", "SELECT id, o.traj_id AS oid, cand.p AS a, o.p AS b FROM cand, tr o WHERE o.dataset = 'original'")},
 near AS (SELECT id, min(d) AS nearest, max(d) AS most FROM scored GROUP BY ALL)
 SELECT id, round(nearest, 6) AS nearest, sum((abs(d - nearest) <= 0.05::DOUBLE * most)::INTEGER)::BIGINT AS plausible, nearest > 0.1::DOUBLE * most OR sum((abs(d - nearest) <= 0.05::DOUBLE * most)::INTEGER) >= 100 AS passes FROM scored JOIN near USING (id) GROUP BY id, nearest, most""")
def _(spark, d):
    own = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    o, s = both(a.short_trips(spark, d).groupBy("dataset", F.col("traj_id").alias("id")).agg(own.alias("v")))
    return attack.plausible_deniability(s.orderBy("id").limit(20).select("id", "v"), o.select("v"), None, "dtw", 0.1, 0.05, 100).select("id", r6("nearest"), "plausible", "passes")


@query("k11_outlier_leakage")
def _(spark, d):
    o, s = both(a.points(spark, d))
    return attack.outlier_leakage(o, s)


# Networks and similarity.
@query("m1_chunks", f"WITH {a.POINTS}, c AS (SELECT traj_id, seq, unnest(CASE WHEN seq % 9 = 0 AND seq >= 9 THEN [seq // 9 - 1, seq // 9] ELSE [seq // 9] END) AS chunk FROM pts) SELECT traj_id, seq, CAST(chunk AS INTEGER) AS chunk FROM (SELECT *, count(*) OVER (PARTITION BY traj_id, chunk) AS n FROM c) WHERE n > 1")
def _(spark, d):
    return network.chunk_points(a.points(spark, d), 10, 1).select("traj_id", "seq", "chunk")


@query("m2_stitch", f"WITH {a.POINTS}, c AS (SELECT traj_id, x, seq // 10 AS chunk, seq % 10 AS idx FROM pts), k AS (SELECT * FROM c WHERE chunk = 0 OR idx > 0) SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY chunk, idx) - 1 AS seq, round(x, 6) AS x FROM k")
def _(spark, d):
    g = a.points(spark, d).select("dataset", "traj_id", "x", F.floor(F.col("seq") / 10).alias("chunk"), (F.col("seq") % 10).alias("idx"))
    return network.stitch_chunks(g).select("traj_id", "seq", r6("x"))


@query("m4_end_times", f"WITH {a.POINTS}, n AS (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM pts) SELECT traj_id, seq, CASE WHEN n = 1 THEN 0.0 ELSE round_even(6000.0::DOUBLE * seq / (n - 1), 0) END AS t FROM n")
def _(spark, d):
    return network.interp_end_times(a.points(spark, d).withColumn("t0", F.lit(0)).withColumn("t1", F.lit(6000))).select("traj_id", "seq", "t")


@query("m3_anchor_times", f"WITH {a.POINTS}, k AS (SELECT *, CASE WHEN seq % 5 = 2 THEN epoch(ts) END AS k FROM pts), w AS (SELECT *, last_value(k IGNORE NULLS) OVER b AS t0, last_value(CASE WHEN k IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS s0, first_value(k IGNORE NULLS) OVER f AS t1, first_value(CASE WHEN k IS NOT NULL THEN seq END IGNORE NULLS) OVER f AS s1 FROM k WINDOW b AS (PARTITION BY dataset, traj_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY dataset, traj_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT traj_id, seq, round(CASE WHEN k IS NOT NULL THEN k ELSE coalesce(t0 + (t1 - t0) * (seq - s0) * 1.0::DOUBLE / nullif(s1 - s0, 0), t0) END, 6) AS t FROM w")
def _(spark, d):
    return network.interp_anchor_times(a.points(spark, d).withColumn("t", F.when(F.col("seq") % 5 == 2, F.unix_timestamp("ts")))).select("traj_id", "seq", r6("t"))


_COARSE = f"WITH {a.POINTS}, g AS (SELECT dataset, traj_id, seq, floor(x / 100) / 100 AS x, floor(y / 20) / 100 AS y FROM pts), ky AS (SELECT *, CAST(round(x * 1e7) AS BIGINT) AS kx, CAST(round(y * 1e7) AS BIGINT) AS kk FROM g), nd AS (SELECT kx, kk, min((traj_id, seq)) AS fst, arg_min(x, (traj_id, seq)) AS lon, arg_min(y, (traj_id, seq)) AS lat FROM ky GROUP BY ALL), nodes AS (SELECT *, row_number() OVER (ORDER BY fst) - 1 AS node_id FROM nd), st AS (SELECT k.dataset, k.traj_id, k.seq, node_id, lon, lat, lead(node_id) OVER w AS n2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM ky k JOIN nodes USING (kx, kk) WINDOW w AS (PARTITION BY k.dataset, k.traj_id ORDER BY k.seq)), pr AS (SELECT node_id, n2, min((traj_id, seq)) AS fst, any_value(lon) AS x, any_value(lat) AS y, any_value(lon2) AS x2, any_value(lat2) AS y2 FROM st WHERE n2 IS NOT NULL AND n2 <> node_id GROUP BY node_id, n2), edges AS (SELECT row_number() OVER (ORDER BY fst) - 1 AS edge_id, node_id AS start_node, n2 AS end_node, 2 * 6371000 * asin(sqrt(least(pow(sin((radians(y2) - radians(y)) / 2), 2) + cos(radians(y)) * cos(radians(y2)) * pow(sin(radians(x2 - x) / 2), 2), 1))) AS length FROM pr)"


def _registry(spark, d):
    p = a.points(spark, d).withColumn("x", F.floor(F.col("x") / 100) / 100).withColumn("y", F.floor(F.col("y") / 20) / 100)
    return p, *network.build_registry(p)


@query("m5_m6_registry", f"{_COARSE} SELECT edge_id, start_node, end_node, round(length, 4) AS length FROM edges")
def _(spark, d):
    return _registry(spark, d)[2].select("edge_id", "start_node", "end_node", F.round("length", 4).alias("length"))


@query("m6_geometry_to_segments", f"{_COARSE}, s AS (SELECT traj_id, seq, edge_id, lag(edge_id) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS b FROM st JOIN edges ON start_node = node_id AND end_node = n2) SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS \"order\", edge_id AS segment_id FROM s WHERE b IS NULL OR b <> edge_id")
def _(spark, d):
    return network.geometry_to_segments(*_registry(spark, d)).select("traj_id", "order", "segment_id")


@query("m8_m9_attach_network", f"{_COARSE}, s AS (SELECT dataset, traj_id, seq, edge_id, start_node, end_node, lag(edge_id) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS b FROM st JOIN edges ON start_node = node_id AND end_node = n2), g2 AS (SELECT *, row_number() OVER (PARTITION BY dataset, traj_id ORDER BY seq) - 1 AS o FROM s WHERE b IS NULL OR b <> edge_id), p AS (SELECT dataset, traj_id, 0 AS seq, start_node AS node_id FROM g2 WHERE o = 0 UNION ALL SELECT dataset, traj_id, o + 1, end_node FROM g2), ln AS (SELECT dataset, traj_id, max(seq) AS l FROM pts GROUP BY ALL) SELECT p.traj_id, p.seq::BIGINT AS seq, p.node_id, q.ts FROM p JOIN ln USING (dataset, traj_id) JOIN pts q ON q.dataset = p.dataset AND q.traj_id = p.traj_id AND q.seq = least(p.seq, l) UNION ALL SELECT traj_id, seq, NULL, ts FROM pts ANTI JOIN g2 USING (dataset, traj_id)")
def _(spark, d):
    p, nodes, edges = _registry(spark, d)
    o, s = both(network.geometry_to_segments(p, nodes, edges))
    return network.attach_network(p, network.combine_segments(o, s), nodes).select("traj_id", "seq", "node_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("m11_nearest_road", f"WITH {a.GPS}, {a.EDGES}, nodes AS (SELECT CAST(range AS BIGINT) AS node_id, -8.7::DOUBLE + 0.03::DOUBLE * (range % 15) AS lon, 41.0::DOUBLE + 0.03::DOUBLE * (range // 15) AS lat FROM range(199)), ds AS (SELECT DISTINCT x, y FROM gps), nn AS (SELECT x, y, arg_min(node_id, (round(sqrt(pow(x - lon, 2) + pow(y - lat, 2)), 12), node_id)) AS node_id FROM ds, nodes GROUP BY ALL) SELECT traj_id, seq, node_id FROM gps JOIN nn USING (x, y)")
def _(spark, d):
    return network.nearest_road(a.gps(spark, d), _nodes(spark)).select("traj_id", "seq", "node_id")


_ALONG = "least(greatest(((x - lon) * (lon2 - lon) + (y - lat) * (lat2 - lat)) / nullif(pow(lon2 - lon, 2) + pow(lat2 - lat, 2), 0), 0), 1)"


@query("m11_nearest_edge", f"WITH {a.GPS}, {a.EDGES}, nodes AS (SELECT CAST(range AS BIGINT) AS node_id, -8.7::DOUBLE + 0.03::DOUBLE * (range % 15) AS lon, 41.0::DOUBLE + 0.03::DOUBLE * (range // 15) AS lat FROM range(199)), li AS (SELECT edge_id, u.lon, u.lat, v.lon AS lon2, v.lat AS lat2 FROM edges JOIN nodes u ON u.node_id = start_node JOIN nodes v ON v.node_id = end_node), ds AS (SELECT DISTINCT x, y FROM gps), al AS (SELECT *, coalesce({_ALONG}, 0) AS t FROM ds, li), ne AS (SELECT x, y, arg_min(edge_id, (round(sqrt(pow(x - (lon + t * (lon2 - lon)), 2) + pow(y - (lat + t * (lat2 - lat)), 2)), 12), edge_id)) AS edge_id FROM al GROUP BY ALL), w AS (SELECT traj_id, dataset, seq, edge_id, lag(edge_id) OVER (PARTITION BY dataset, traj_id ORDER BY seq) AS b FROM gps JOIN ne USING (x, y)) SELECT traj_id, seq, edge_id FROM w WHERE b IS NULL OR b <> edge_id")
def _(spark, d):
    return network.drop_repeated(network.nearest_road(a.gps(spark, d), _nodes(spark), a.edges(spark, d)), "edge_id").select("traj_id", "seq", "edge_id")


def _nodes(spark):
    """Places of the road network's 199 nodes."""
    return spark.range(199).select(F.col("id").alias("node_id"), (-8.7 + 0.03 * (F.col("id") % 15)).alias("lon"), (41.0 + 0.03 * F.floor(F.col("id") / 15)).alias("lat"))


@query("m10_downsample", f"WITH {a.POINTS}, n AS (SELECT traj_id, count(*) AS n FROM pts GROUP BY ALL), i AS (SELECT traj_id, n, unnest(range(least(n, 50))) AS i FROM n) SELECT i.traj_id, CAST(i AS INTEGER) AS seq, round(p.x, 6) AS x, p.y FROM i JOIN pts p ON p.traj_id = i.traj_id AND p.seq = CASE WHEN n > 50 THEN CAST(round_even(i * (n - 1) / 49, 0) AS BIGINT) ELSE i END")
def _(spark, d):
    return network.downsample(a.points(spark, d), 50).select("traj_id", "seq", r6("x"), "y")


def _double(k: int) -> str:
    """Shortest ways of up to twice as many edges, from d<k>."""
    return f"d{k + 1} AS MATERIALIZED (SELECT u, v, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT p.u, q.v, p.d + q.d FROM d{k} p JOIN d{k} q ON p.v = q.u WHERE p.d + q.d <= 10000) GROUP BY ALL)"


@query("m12_network_distance", f"WITH {a.EDGES}, o AS (SELECT least(start_node, end_node) AS u, greatest(start_node, end_node) AS v, arg_max(length, edge_id) AS d FROM edges GROUP BY ALL), d0 AS MATERIALIZED (SELECT u, v, d FROM o WHERE u <> v AND d <= 10000 UNION ALL SELECT v, u, d FROM o WHERE u <> v AND d <= 10000), {', '.join(_double(k) for k in range(4))}, p AS (SELECT DISTINCT start_node AS a, (end_node * 3) % 199 AS b FROM edges) SELECT a, b, round(CASE WHEN a = b THEN 0 ELSE coalesce(d, 10000) END, 6) AS d FROM p LEFT JOIN d4 ON u = a AND v = b")
def _(spark, d):
    e = a.edges(spark, d)
    pairs = e.select(F.col("start_node").alias("a"), ((F.col("end_node") * 3) % 199).alias("b")).distinct()
    return network.network_distance(pairs, e).select("a", "b", r6("d"))


@query("t8_trip_length", f"WITH {a.SHORT}, {a.EDGES} SELECT traj_id, round(sum(length), 6) AS metres FROM trips JOIN edges ON segment_id = edge_id GROUP BY ALL")
def _(spark, d):
    t = a.short_trips(spark, d)
    return similarity.trip_length(t, t, a.edges(spark, d)).select("traj_id", r6("metres"))


@query("t9_length_groups", f"WITH {a.SHORT}, {a.EDGES}, l AS (SELECT traj_id, sum(length) AS m FROM trips JOIN edges ON segment_id = edge_id GROUP BY ALL) SELECT CASE WHEN m <= 750 THEN 'small' WHEN m <= 1250 THEN 'medium' WHEN m >= 2000 THEN 'large' ELSE 'gap' END AS grp, count(*) AS n FROM l GROUP BY ALL")
def _(spark, d):
    t = a.short_trips(spark, d)
    return similarity.trip_length(t, t, a.edges(spark, d)).groupBy(similarity.length_group(F.col("metres")).alias("grp")).agg(F.count("*").alias("n"))


@query("t12_summary", f"WITH {a.POINTS} SELECT dataset, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(quantile_cont(x, 0.5), 6) AS median, round(max(x), 6) AS high FROM pts GROUP BY ALL")
def _(spark, d):
    s = similarity.summarise(a.points(spark, d).withColumnRenamed("x", "score"), ["dataset"])
    return s.select("dataset", "n", *[r6(c) for c in ("mean", "std", "low", "median", "high")])


@query("t13_size_stats", f"WITH {a.SHORT}, n AS (SELECT dataset, traj_id, count(*) AS n FROM trips GROUP BY ALL) SELECT dataset, min(n) AS points_min, round(avg(n), 6) AS points_avg, max(n) AS points_max, min(n) AS segments_min, round(avg(n), 6) AS segments_avg, max(n) AS segments_max FROM n GROUP BY ALL")
def _(spark, d):
    t = a.short_trips(spark, d)
    return similarity.size_stats(t, t).withColumn("points_avg", F.round("points_avg", 6)).withColumn("segments_avg", F.round("segments_avg", 6))


def _scores(spark, d, m):
    o, s = both(similarity.trajs(a.gps(spark, d)))
    return similarity.compare(o, s, m, 10_000).withColumn("score", F.round("score", 6))


#: Every pair of the trips; the queries draw 10,000 where there are more, which is above scale 0.01.
_TRIP_PAIRS = f"{a.GPS}, tr AS (SELECT dataset, traj_id, list({{'x': x, 'y': y}} ORDER BY seq) AS p FROM gps GROUP BY ALL)"
_EVERY = "SELECT comparison, l.traj_id AS i, r.traj_id AS j, l.p AS a, r.p AS b FROM (VALUES ('OO', 'original', 'original'), ('OS', 'original', 'synthetic'), ('SS', 'synthetic', 'synthetic')) v(comparison, ld, rd) JOIN tr l ON l.dataset = ld JOIN tr r ON r.dataset = rd"
_METRES = "(2 * 6371000 * asin(sqrt(least(pow(sin((radians(b[{j}].y) - radians(a[{i}].y)) / 2), 2) + cos(radians(a[{i}].y)) * cos(radians(b[{j}].y)) * pow(sin(radians(b[{j}].x - a[{i}].x) / 2), 2), 1))))"


def _edit(rows: str, cost: str, gap: str, keys: str = "comparison, i, j") -> str:
    """Least cost of edits: `cost` for points {i} and {j}, `gap` for a skip."""
    here = "w.k + 1 - z"
    inner = f"least(w.d2[z] + {cost.format(i='z', j=f'({here})')}, w.d1[z + 1] + {gap}, w.d1[z] + {gap})"
    step = f"CASE WHEN z = 0 OR {here} = 0 THEN (w.k + 1) * {gap} WHEN {here} NOT BETWEEN 0 AND n THEN {_INF} ELSE {inner} END"
    return _dp(keys, rows, f"[CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE {_INF} END FOR z IN range(m + 1)]", step.replace("i IN", "z IN"), "k = m + n").replace("FOR i IN range(len(w.d1))", "FOR z IN range(len(w.d1))")


def _subsequence(rows: str, same: str, weight: str, keys: str = "i, j") -> str:
    """Heaviest common subsequence."""
    here = "w.k + 1 - z"
    inner = f"CASE WHEN {same.format(i='z', j=f'({here})')} THEN w.d2[z] + {weight.format(i='z')} ELSE greatest(w.d1[z + 1], w.d1[z]) END"
    step = f"CASE WHEN z = 0 OR {here} <= 0 OR {here} > n THEN 0.0::DOUBLE ELSE {inner} END"
    return _dp(keys, rows, "[0.0::DOUBLE FOR z IN range(m + 1)]", step, "k = m + n").replace("FOR i IN range(len(w.d1))", "FOR z IN range(len(w.d1))")


@query("t1_t10_compare_edr", f"WITH RECURSIVE {_TRIP_PAIRS}, {_edit(_EVERY, f'CASE WHEN {_METRES} > 20000 THEN 1.0 ELSE 0.0 END', '1.0::DOUBLE')} SELECT comparison, i, j, round(d, 6) AS score FROM scored")
def _(spark, d):
    return _scores(spark, d, measure("edr", threshold=20_000.0))


@query("t3_compare_erp", f"WITH RECURSIVE {_TRIP_PAIRS}, {_edit(_EVERY, f'{_METRES} / 1000', '10.0::DOUBLE')} SELECT comparison, i, j, round(d, 6) AS score FROM scored")
def _(spark, d):
    return _scores(spark, d, measure("erp", gap=10.0))


@query("t6_compare_dtw", f"WITH RECURSIVE {_TRIP_PAIRS}, {_dtw('comparison, i, j', _EVERY)} SELECT comparison, i, j, round(d, 6) AS score FROM scored")
def _(spark, d):
    return _scores(spark, d, measure("dtw"))


_LATE = "list_avg([exp(-greatest(z - ({n} - 1), 0)) FOR z IN range({m})])"
_TP = f"-(0.99 * (list_avg([list_max([exp(-{_METRES.format(i='u', j='v')} / 1000) FOR v IN range(1, len(b) + 1)]) FOR u IN range(1, len(a) + 1)]) + list_avg([list_max([exp(-{_METRES.format(i='u', j='v')} / 1000) FOR u IN range(1, len(a) + 1)]) FOR v IN range(1, len(b) + 1)])) + 0.01 * ({_LATE.format(m='len(a)', n='len(b)')} + {_LATE.format(m='len(b)', n='len(a)')}))"


@query("t7_compare_tp", f"WITH {_TRIP_PAIRS} SELECT comparison, i, j, round({_TP}, 6) AS score FROM ({_EVERY})")
def _(spark, d):
    return _scores(spark, d, measure("tp"))


def _on_network(spark, d, m):
    """Pairs of the short trips, as the nodes at which their segments end."""
    e = a.edges(spark, d)
    ends = a.short_trips(spark, d).join(e.select(F.col("edge_id").alias("segment_id"), "end_node"), "segment_id")
    own = F.array_sort(F.collect_list(F.struct("seq", "end_node")))
    o, s = both(ends.groupBy("dataset", "traj_id").agg(F.transform(own, lambda p: p["end_node"]).alias("nodes")))
    return similarity.score_on_network(similarity.sample_pairs(o, s, 10_000), o, s, e, m)


@query("t2_network_edr")
def _(spark, d):
    return _on_network(spark, d, matrix_measure("edr", threshold=3000.0))


@query("t3_network_erp")
def _(spark, d):
    return _on_network(spark, d, matrix_measure("erp"))


@query("t7_network_tp")
def _(spark, d):
    return _on_network(spark, d, matrix_measure("tp"))


#: Each original with the synthetic trip of the next number.
_NEXT = f"{a.SHORT}, {a.EDGES}, sg AS (SELECT dataset, traj_id, list({{'id': segment_id, 'length': length}} ORDER BY seq) AS p FROM trips JOIN edges ON segment_id = edge_id GROUP BY ALL)"
_NEXT_PAIRS = "SELECT l.traj_id AS i, r.traj_id AS j, l.p AS a, r.p AS b FROM sg l JOIN sg r ON r.traj_id = l.traj_id + 1 WHERE l.dataset = 'original'"
_SAME = "a[{i}].id = b[{j}].id"


def _next_pairs(o, s):
    return o.select(F.col("traj_id").alias("i"), (F.col("traj_id") + 1).alias("j")).join(s.select(F.col("traj_id").alias("j")), "j").select("i", "j")


@query("t4_lors_next", f"WITH RECURSIVE {_NEXT}, {_subsequence(_NEXT_PAIRS, _SAME, 'a[{i}].length')} SELECT i, j, round(-d, 6) + 0 AS score FROM scored")
def _(spark, d):
    o, s = both(_segments(spark, d))
    return similarity.score_pairs(_next_pairs(o, s), o, s, lors()).select("i", "j", (F.round("score", 6) + 0).alias("score"))


@query("t5_lcrs_next", f"WITH RECURSIVE {_NEXT}, {_subsequence(_NEXT_PAIRS, _SAME, '1.0')} SELECT i, j, round(-d / (m + n - d), 6) + 0 AS score FROM scored JOIN pr USING (i, j)")
def _(spark, d):
    o, s = both(_segments(spark, d).withColumn("pts", F.transform("pts", lambda x: x["id"])))
    return similarity.score_pairs(_next_pairs(o, s), o, s, measure("lcrs")).select("i", "j", (F.round("score", 6) + 0).alias("score"))


@query("t4_lors")
def _(spark, d):
    o, s = both(_segments(spark, d))
    return similarity.score_pairs(similarity.sample_pairs(o, s, 10_000), o, s, lors())


@query("t5_lcrs")
def _(spark, d):
    o, s = both(_segments(spark, d).withColumn("pts", F.transform("pts", lambda x: x["id"])))
    return similarity.score_pairs(similarity.sample_pairs(o, s, 10_000), o, s, measure("lcrs"))


def _segments(spark, d):
    """Trips as arrays of segments with their lengths, worked out once for all that reads them."""
    t = a.short_trips(spark, d).join(a.edges(spark, d).select(F.col("edge_id").alias("segment_id"), "length"), "segment_id")
    own = F.array_sort(F.collect_list(F.struct("seq", F.col("segment_id").alias("id"), "length")))
    return cut(t.groupBy("dataset", "traj_id").agg(F.transform(own, lambda p: F.struct(p["id"].alias("id"), p["length"].cast("double").alias("length"))).alias("pts")))


@query("t11_compare_by_length")
def _(spark, d):
    t = a.short_trips(spark, d)
    lengths = similarity.trip_length(t, t, a.edges(spark, d))
    o, s = both(_segments(spark, d).withColumn("pts", F.transform("pts", lambda x: x["id"])))
    return similarity.compare_by_length(o, s, lengths, measure("lcrs"), 10_000)


@query("u4_random_queries")
def _(spark, d):
    g = grid.data_bounds(a.points(spark, d), 1)
    return utility.random_queries(spark, g.x0, g.x1, g.y0, g.y1, 200).join(utility.touching_points(a.points(spark, d), utility.random_queries(spark, g.x0, g.x1, g.y0, g.y1, 200)), "query_id")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
