"""Readers and writers over small files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayveil.sources import trajectories as io


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_geolife(spark, tmp_path):
    head = "Geolife trajectory\n" * 6
    put(tmp_path / "007/Trajectory/a.plt", head + "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\r\n39.8,116.4,0,492,39744.2,2008-10-23,02:53:10\nbad,line\n")
    put(tmp_path / "008/Trajectory/b.plt", head + "40.0,116.0,0,1,2,2009-01-01,00:00:00\n")
    put(tmp_path / "008/labels.txt", "no log")
    got = [(r.user, r.seq, r.x, r.y, r.ts) for r in io.read_geolife(spark, str(tmp_path)).orderBy("user", "seq").collect()]
    assert got == [("007", 0, 116.3, 39.9, datetime(2008, 10, 23, 2, 53, 4)), ("007", 1, 116.4, 39.8, datetime(2008, 10, 23, 2, 53, 10)), ("008", 0, 116.0, 40.0, datetime(2009, 1, 1))]


def test_tdrive(spark, tmp_path):
    put(tmp_path / "x/1.txt", "1,2008-02-02 15:36:08,116.51172,39.92123\n1,not a time,1,2\n1,2008-02-02 15:46:08,oops,39.9\n")
    put(tmp_path / "2.txt", "2,2008-02-02 13:33:52,116.36422,39.88781\n")
    got = {(r.taxi, r.ts, r.x, r.y) for r in io.read_tdrive(spark, str(tmp_path)).collect()}
    assert got == {(1, datetime(2008, 2, 2, 15, 36, 8), 116.51172, 39.92123), (2, datetime(2008, 2, 2, 13, 33, 52), 116.36422, 39.88781)}


def test_porto(spark, tmp_path):
    line = '"[[-8.61,41.14],[-8.62,41.15],[-8.63,41.16]]"'
    put(tmp_path / "p.csv", f'TRIP_ID,TIMESTAMP,MISSING_DATA,POLYLINE\n"T1",1372636858,False,{line}\n"T2",1372636858,True,{line}\n"T3",1372636858,False,"[[1,2]]"\n')
    got = [(r.trip, r.seq, r.x, r.y, r.ts) for r in io.read_porto(spark, str(tmp_path / "p.csv")).orderBy("seq").collect()]
    first = datetime(2013, 7, 1, 0, 0, 58)
    assert got == [("T1", 0, -8.61, 41.14, first), ("T1", 1, -8.62, 41.15, first.replace(minute=1, second=13)), ("T1", 2, -8.63, 41.16, first.replace(minute=1, second=28))]


def test_folder_of_trips_and_back_to_text(spark, tmp_path):
    put(tmp_path / "in/trip_12.txt", "(41.1, -8.6)\n41.2,-8.5\n")
    put(tmp_path / "in/trip_3.txt", "41.0,-8.0\n")
    got = io.read_traj_folder(spark, str(tmp_path / "in"))
    assert [(r.traj_id, r.seq, r.x, r.y) for r in got.orderBy("seq").collect()] == [(12, 0, -8.6, 41.1), (12, 1, -8.5, 41.2)]
    io.write_dat(got, str(tmp_path / "out"), header_colon=False, decimals=8)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "#12\n>0:-8.60000000,41.10000000;-8.50000000,41.20000000;\n"


def test_text_ids_and_times(spark, tmp_path):
    put(tmp_path / "a.dat", "#7:\n>0:1,2,2009-01-01 00:00:00;3,4,2009/01/01 00:01:00;\n#9\n>0:;\n#20:\n>0:5,6,2009-01-01T00:02:00;x,y;7,8;\n")
    got = {(r.traj_id, r.seq, r.x, r.y) for r in io.read_dat(spark, str(tmp_path / "a.dat")).collect()}
    assert got == {(7, 0, 1.0, 2.0), (7, 1, 3.0, 4.0), (20, 0, 5.0, 6.0), (20, 2, 7.0, 8.0)}
    dense = {(r.traj_id, r.x) for r in io.read_dat(spark, str(tmp_path / "a.dat"), ids="ordinal").collect()}
    assert dense == {(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0)}
    timed = io.read_dat(spark, str(tmp_path / "a.dat"), require_ts=True).collect()
    assert sorted(r.x for r in timed) == [1.0, 3.0, 5.0]


def test_network_files(spark, tmp_path):
    nodes = spark.createDataFrame([(0, -8.6, 41.1), (1, -8.5, 41.2)], "node_id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 0, 1, 12.5)], "edge_id long, start_node long, end_node long, length double")
    segs = spark.createDataFrame([("original", 5, 0, 0, 0, 1)], "dataset string, traj_id long, `order` int, segment_id long, start_node long, end_node long")
    io.write_network(nodes, edges, segs, str(tmp_path / "net"))
    for a, b in zip((nodes, edges, segs), io.read_network(spark, str(tmp_path / "net"))):
        assert a.schema.names == b.schema.names and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_reports_and_synthetic_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "user long, risk double")
    for k in (1, 2):
        io.write_report(df, str(tmp_path / "r"), "porto", "m", 1.0, k, "bayes")
    back = spark.read.option("header", "true").csv(str(tmp_path / "r"))
    assert {(r.dataset, r.model, r.iteration, r.attack, r.user, r.risk) for r in back.collect()} == {("porto", "m", k, "bayes", "1", "0.5") for k in (1, 2)}
    put(tmp_path / "eps_0.5/x-iteration3.dat", "#1:\n>0:1,2;3,4;\n")
    got = io.list_synthetic(io.read_dat(spark, str(tmp_path / "eps_0.5"), "synthetic")).select("epsilon", "iteration").distinct().collect()
    assert [tuple(r) for r in got] == [(0.5, 3)]


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 * 3).alias("traj_id"), F.lit("original").alias("dataset"))
    assert {(r.traj_id) for r in io.dense_ids(df).collect()} == set(range(1000))


def test_a_log_is_one_file_and_nothing_beside_it(spark, tmp_path):
    """Spark's writer leaves a checksum beside each log and takes a process for the rights of each."""
    pts = spark.range(900).select((F.col("id") % 300).alias("traj_id"), F.floor(F.col("id") / 300).alias("seq"), F.col("id").cast("double").alias("x"), (F.col("id") / 8).alias("y"))
    want = sorted((r.traj_id, r.seq, r.x, r.y) for r in pts.collect())
    io.write_traj_folder(pts, str(tmp_path / "trips"))
    files = [p for p in (tmp_path / "trips").rglob("*") if p.is_file()]
    assert len(files) == 300 and {p.parent.name for p in files} == {f"traj_id={k}" for k in range(300)}
    assert sorted(tuple(r) for r in io.read_traj_folder(spark, str(tmp_path / "trips")).collect()) == want
    with pytest.raises(Exception, match="trips"):
        io.write_traj_folder(pts, str(tmp_path / "trips"))


def test_folders_are_named_as_spark_names_them(spark, tmp_path):
    names = ["a b", "x:y", "50%", "p/q", "e=f", "ü", "[k]{l}^\\'\"#*?\t", "", None]
    texts = spark.createDataFrame([(n, str(k)) for k, n in enumerate(names)], "user string, value string")
    io._write_files(texts, str(tmp_path / "ours"), "user")
    texts.coalesce(1).write.option("maxRecordsPerFile", 1).partitionBy("user").text(str(tmp_path / "theirs"))
    read = lambda name: sorted((p.parent.name, p.read_text()) for p in (tmp_path / name).rglob("*.txt"))
    assert read("ours") == read("theirs") and len(read("ours")) == len(names)


def test_logs_go_through_any_file_system(spark, tmp_path):
    (tmp_path / "far").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./far", f"file://{tmp_path}/far")
    pts = spark.createDataFrame([("u", "l", 0, 1.5, 2.5, datetime(2009, 1, 1)), ("u", "l", 1, 3.5, 4.5, datetime(2009, 1, 2)), ("v", "l", 0, 5.5, 6.5, datetime(2009, 1, 3))], "user string, log string, seq int, x double, y double, ts timestamp")
    for root in ("viewfs://logs/far/geo", str(tmp_path / "near")):
        io.write_geolife(pts, root)
        got = io.read_geolife(spark, root, "*.txt").select("user", "seq", "x", "y", "ts").collect()
        assert sorted(tuple(r) for r in got) == sorted((r.user, r.seq, r.x, r.y, r.ts) for r in pts.collect())


def test_no_logs(spark, tmp_path):
    io.write_traj_folder(spark.createDataFrame([], "traj_id long, seq long, x double, y double"), str(tmp_path / "none"))
    assert io.read_traj_folder(spark, str(tmp_path / "none")).count() == 0
