"""Readers and writers: trajectory text, raw GPS logs, road networks, reports."""

from __future__ import annotations

import os
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayveil.functions.scalar import parse_ts, point_time
from wayveil.functions.tables import ranked
from wayveil.functions.workers import ready


def read_dat(spark: SparkSession, path: str, dataset: str = "original", min_points: int = 1, require_ts: bool = False, ids: str = "header") -> DataFrame:
    """Points of trajectory text: `#id` or `#id:`, then `>0:x,y[,time];...`. One record is one trip, so nothing shuffles.

    ids: "header", or "ordinal", the place of the trip among those that have points, by its header's number and file.
    """
    raw = spark.read.option("lineSep", "#").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    trips = raw.select(F.regexp_extract("value", r"^\s*(\d+)", 1).alias("id"), F.regexp_extract("value", r">0:([^\n]*)", 1).alias("body"), "file").where("id != '' and body != ''")
    items = F.filter(F.split("body", ";"), lambda x: F.trim(x) != "")
    parts = F.filter(F.transform(items, lambda x: F.split(x, ",")), lambda p: F.size(p) >= 2)
    pts = trips.select(F.col("id").cast("long").alias("traj_id"), "file", parts.alias("p")).where(F.size("p") >= min_points).select("traj_id", "file", F.posexplode("p").alias("seq", "p"))
    pts = pts.select(F.lit(dataset).alias("dataset"), "traj_id", "seq", F.trim(F.col("p")[0]).try_cast("double").alias("x"), F.trim(F.col("p")[1]).try_cast("double").alias("y"), parse_ts(F.trim(F.try_element_at("p", F.lit(3)))).alias("ts"), "file").where("x is not null and y is not null")
    pts = pts.where("ts is not null") if require_ts else pts
    if ids == "header":
        return pts
    places = ranked(pts.select("file", "traj_id").distinct(), ["file", "traj_id"], "_place")
    return pts.join(places, ["file", "traj_id"]).withColumn("traj_id", F.col("_place")).select(*pts.columns)


def _number(v: Column, decimals: int | None) -> Column:
    return v.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", v)


def write_dat(pts: DataFrame, path: str, header_colon: bool = True, decimals: int | None = None, with_ts: bool = False) -> None:
    """Trajectory text, a trip in two lines."""
    item = F.concat_ws(",", _number(F.col("x"), decimals), _number(F.col("y"), decimals), *([F.date_format("ts", "yyyy-MM-dd HH:mm:ss")] if with_ts else []))
    trips = pts.select("traj_id", F.struct("seq", item.alias("item")).alias("p")).groupBy("traj_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    body = F.concat(F.lit(">0:"), F.array_join(F.transform("p", lambda p: F.concat(p["item"], F.lit(";"))), ""))
    trips.select(F.concat(F.lit("#"), F.col("traj_id").cast("string"), F.lit(":" if header_colon else ""), F.lit("\n"), body).alias("value")).write.text(path)


def _log_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """value, file: whole files under root, one a row."""
    read = spark.read.option("recursiveFileLookup", "true")
    return (read.option("pathGlobFilter", glob) if glob else read).text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _folder(column: str, value) -> str:
    """`column=value` with what Spark escapes in the names of folders."""
    return f"{column}=" + ("__HIVE_DEFAULT_PARTITION__" if value in (None, "") else re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(value)))


def _write_files(texts: DataFrame, root: str, *folders: str) -> None:
    """A file for each row of (folders, value), under folders named `column=value`.

    In a mounted folder the tasks write each file under another name and rename it, so a task that runs again changes
    nothing. Spark's writer starts a process for the rights of every folder and file there and moves all of them on the driver.
    """
    spark = texts.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        return texts.repartition(*folders).write.option("maxRecordsPerFile", 1).partitionBy(*folders).text(root)
    if system.exists(at):
        raise FileExistsError(root)
    system.mkdirs(at)
    base = system.makeQualified(at).toUri().getPath()

    def write(batches):
        for rows in batches:
            for *keys, value in rows.itertuples(index=False):
                folder = os.path.join(base, *map(_folder, folders, keys))
                os.makedirs(folder, exist_ok=True)
                new = os.path.join(folder, f"_{uuid.uuid4().hex}")
                with open(new, "w", encoding="utf-8", newline="") as out:
                    out.write((value or "") + "\n")
                os.replace(new, os.path.join(folder, f"part-{zlib.crc32(repr(keys).encode()):08x}.txt"))
            yield pd.DataFrame({"n": [len(rows)]})

    ready(spark)
    texts.select(*[F.col(c).cast("string") for c in folders], "value").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def read_geolife(spark: SparkSession, root: str, glob: str = "*.plt") -> DataFrame:
    """`.plt` logs under <user>/Trajectory, or as write_geolife leaves them: six header lines, then lat,lon,_,_,_,date,time."""
    logs = _log_files(spark, root, glob).select("file", F.regexp_extract("file", r"([^/=]+)/[^/]+/[^/]+$", 1).alias("user"), "value")  # once a file, not once a line
    lines = logs.select("user", "file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where("line >= 6").select("user", "file", "line", F.split("text", ",").alias("f")).where(F.size("f") >= 7)
    return lines.select("user", "file", (F.col("line") - 6).alias("seq"), F.col("f")[1].try_cast("double").alias("x"), F.col("f")[0].try_cast("double").alias("y"), parse_ts(F.concat_ws(" ", F.trim(F.col("f")[5]), F.trim(F.col("f")[6]))).alias("ts"))


def write_geolife(pts: DataFrame, root: str) -> None:
    """Points (user, log, seq, x, y, ts) as logs in the same form, a file a log, under user=<user>/log=<log>."""
    line = F.concat_ws(",", F.col("y").cast("string"), F.col("x").cast("string"), F.lit("0,0,0"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    logs = pts.groupBy("user", "log").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("p"))
    _write_files(logs.select("user", "log", F.concat(F.lit("Geolife trajectory\n" * 6), F.array_join(F.transform("p", lambda p: p["line"]), "\n")).alias("value")), root, "user", "log")


def read_tdrive(spark: SparkSession, root: str) -> DataFrame:
    """`taxi,time,lon,lat` logs; rows that do not parse are skipped."""
    rows = spark.read.schema("taxi long, ts timestamp, x double, y double").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(root)
    return rows.where("taxi is not null and ts is not null and x is not null and y is not null")


def write_tdrive(pts: DataFrame, root: str) -> None:
    """Points (taxi, ts, x, y) as such logs."""
    pts.select("taxi", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "x", "y").write.csv(root)


def read_porto(spark: SparkSession, path: str, min_points: int = 3) -> DataFrame:
    """Taxi trips with a JSON polyline; rows with missing data and short lines go. A point each 15 s."""
    rows = spark.read.option("header", "true").option("escape", '"').csv(path).where("lower(trim(MISSING_DATA)) = 'false'")
    lines = rows.select(F.col("TRIP_ID").cast("string").alias("trip"), F.col("TIMESTAMP").cast("long").alias("start"), F.from_json("POLYLINE", "array<array<double>>").alias("line")).where(F.size("line") >= min_points)
    return lines.select("trip", "start", F.posexplode("line").alias("seq", "p")).select("trip", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), point_time(F.col("start"), F.col("seq")).alias("ts"))


def read_traj_folder(spark: SparkSession, root: str, lat_lon: bool = True, min_points: int = 2) -> DataFrame:
    """One file a trip, `a,b` or `(a, b)` a line; the trip's id is that of its folder traj_id=<id>, else the number in the
    file's name."""
    whole = _log_files(spark, root)
    pairs = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.split(F.regexp_replace(x, r"[()\s]", ""), ",")), lambda p: F.size(p) >= 2)
    number = F.coalesce(*[F.nullif(F.regexp_extract("file", x, 1), F.lit("")) for x in (r"traj_id=(\d+)/[^/]*$", r"(\d+)[^/]*$")])
    trips = whole.select(number.cast("long").alias("traj_id"), pairs.alias("p")).where(F.size("p") >= min_points)
    x, y = (1, 0) if lat_lon else (0, 1)
    return trips.select("traj_id", F.posexplode("p").alias("seq", "p")).select("traj_id", "seq", F.col("p")[x].try_cast("double").alias("x"), F.col("p")[y].try_cast("double").alias("y"))


def write_porto(trips: DataFrame, path: str) -> None:
    """Trips (trip, start in seconds, missing, line: an array of [x, y]) as such a table."""
    trips.select(F.col("trip").alias("TRIP_ID"), F.col("start").alias("TIMESTAMP"), F.initcap(F.col("missing").cast("string")).alias("MISSING_DATA"), F.to_json("line").alias("POLYLINE")).write.option("header", "true").option("escape", '"').csv(path)


def write_traj_folder(pts: DataFrame, root: str, lat_lon: bool = True) -> None:
    """Points (traj_id, seq, x, y), a file a trip under traj_id=<id>, `a,b` a line."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in (("y", "x") if lat_lon else ("x", "y"))])
    trips = pts.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("p"))
    _write_files(trips.select("traj_id", F.array_join(F.transform("p", lambda p: p["line"]), "\n").alias("value")), root, "traj_id")


def read_network(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and segments under root."""
    read = lambda name, schema: spark.read.schema(schema).option("header", "true").csv(f"{root}/{name}")
    return read("nodes", "node_id long, lon double, lat double"), read("edges", "edge_id long, start_node long, end_node long, length double"), read("segments", "dataset string, traj_id long, `order` int, segment_id long, start_node long, end_node long")


def write_network(nodes: DataFrame, edges: DataFrame, segments: DataFrame, root: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("segments", segments)):
        df.write.option("header", "true").csv(f"{root}/{name}")


def write_report(df: DataFrame, root: str, dataset: str, model: str, epsilon: float, iteration: int, attack: str) -> None:
    """A report under folders by model, budget, iteration and attack."""
    keys = {"dataset": dataset, "model": model, "epsilon": epsilon, "iteration": iteration, "attack": attack}
    df.withColumns({k: F.lit(v) for k, v in keys.items()}).write.mode("append").partitionBy(*keys).option("header", "true").csv(root)


def read_reports(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All reports under root with their own columns (schema) and their keys."""
    keys = "dataset string, model string, epsilon double, iteration int, attack string"
    return spark.read.schema(f"{schema}, {keys}").option("header", "true").csv(root)


def list_synthetic(pts: DataFrame) -> DataFrame:
    """Adds epsilon and iteration, from folders `eps_<number>` and file names with `iteration<number>`."""
    return pts.withColumn("epsilon", F.regexp_extract("file", r"eps_([\d.]+)", 1).try_cast("double")).withColumn("iteration", F.regexp_extract("file", r"iteration_?(\d+)", 1).try_cast("int"))


def dense_ids(pts: DataFrame, order: str = "traj_id") -> DataFrame:
    """Ids 0, 1, ... in the order of another column."""
    ids = ranked(pts.select(order).distinct(), [order], "new_id")
    return pts.join(ids, order).withColumn(order, F.col("new_id")).drop("new_id")
