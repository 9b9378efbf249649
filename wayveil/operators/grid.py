"""Uniform and adaptive grids, cell sequences and counts by cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.workers import ready

TRIP = ["dataset", "traj_id"]


@dataclass(frozen=True)
class Grid:
    """n x n cells over a box; cell = i * n + j with i along x."""

    x0: float
    x1: float
    y0: float
    y1: float
    n: int

    @property
    def w(self) -> float:
        return (self.x1 - self.x0) / self.n

    @property
    def h(self) -> float:
        return (self.y1 - self.y0) / self.n


def data_bounds(pts: DataFrame, n: int, pad: float = 0.0) -> Grid:
    """The data's box, padded; a span of 0 becomes 1e-6. Without points it is the unit square. One row comes to the driver."""
    r = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r["x0"] is None or r["y0"] is None:
        return Grid(0.0, 1.0, 0.0, 1.0, n)
    x1, y1 = (r["x1"] if r["x1"] > r["x0"] else r["x0"] + 1e-6), (r["y1"] if r["y1"] > r["y0"] else r["y0"] + 1e-6)
    return Grid(r["x0"] - pad, x1 + pad, r["y0"] - pad, y1 + pad, n)


def uniform_grid(spark: SparkSession, g: Grid) -> DataFrame:
    """One row a cell: cell, i, j and its box."""
    i, j = F.floor(F.col("id") / g.n), F.col("id") % g.n
    return spark.range(g.n * g.n).select(F.col("id").cast("int").alias("cell"), i.cast("int").alias("i"), j.cast("int").alias("j"), (g.x0 + i * g.w).alias("x0"), (g.x0 + (i + 1) * g.w).alias("x1"), (g.y0 + j * g.h).alias("y0"), (g.y0 + (j + 1) * g.h).alias("y1"))


def _axis(v: Column, low: float, step: float, n: int, mode: str) -> Column:
    up = F.floor((v - low) / step)
    if mode == "floor_clamp":
        return F.least(F.greatest(up, F.lit(0)), F.lit(n - 1))
    if mode == "floor_topclamp":
        return F.least(up, F.lit(n - 1))
    # A point on an inner edge belongs to the lower cell.
    down = F.ceil((v - low) / step) - 1
    if mode == "bins_left":
        out = F.when(v < low - 1e-4, -1).when(v > low + n * step + 1e-4, -1)
        return out.otherwise(F.least(F.greatest(down, F.lit(0)), F.lit(n - 1)))
    return F.least(F.greatest(down, F.lit(0)), F.lit(n - 1))


def assign_cell(pts: DataFrame, g: Grid, mode: str = "floor_clamp") -> DataFrame:
    """Adds cell. Modes: closed_first, floor_clamp, floor_topclamp, snap_lower, bins_left."""
    x, y = F.col("x"), F.col("y")
    if mode == "closed_first":
        inside = x.between(g.x0, g.x1) & y.between(g.y0, g.y1)
        moved = (x - 0.001).between(g.x0, g.x1) & (y - 0.001).between(g.y0, g.y1)
        at = lambda dx: _axis(x - dx, g.x0, g.w, g.n, "lower") * g.n + _axis(y - dx, g.y0, g.h, g.n, "lower")
        cell = F.when(inside, at(0.0)).when(moved, at(0.001)).otherwise(0)
    else:
        i, j = _axis(x, g.x0, g.w, g.n, mode), _axis(y, g.y0, g.h, g.n, mode)
        cell = F.when((i < 0) | (j < 0), -1).otherwise(i * g.n + j) if mode == "bins_left" else i * g.n + j
    return pts.withColumn("cell", cell.cast("int"))


def assign_all_closed(pts: DataFrame, g: Grid) -> DataFrame:
    """A row for every closed cell that holds the point: up to four on edges."""
    both = lambda v, low, step: F.array_distinct(F.array(_axis(v, low, step, g.n, "floor_clamp"), _axis(v, low, step, g.n, "lower")))
    out = pts.withColumn("_i", F.explode(both(F.col("x"), g.x0, g.w))).withColumn("_j", F.explode(both(F.col("y"), g.y0, g.h)))
    return out.withColumn("cell", (F.col("_i") * g.n + F.col("_j")).cast("int")).drop("_i", "_j")


def cell_sequence(cell_pts: DataFrame, dedupe: bool = True, pad_single: bool = False) -> DataFrame:
    """dataset, traj_id, seq, cell without consecutive repeats, numbered anew; pad_single doubles a lone cell."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    out = cell_pts.select(*TRIP, "seq", "cell")
    if dedupe:
        out = out.withColumn("_before", F.lag("cell").over(own)).where("_before is null or cell != _before").drop("_before")
    out = out.withColumn("seq", (F.row_number().over(own) - 1).cast("long"))
    if pad_single:
        out = out.withColumn("_n", F.count("*").over(W.partitionBy(*TRIP)))
        out = out.withColumn("seq", F.explode(F.when(F.col("_n") == 1, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.array("seq")))).drop("_n")
    return out


def run_lengths(cell_pts: DataFrame) -> DataFrame:
    """dataset, traj_id, run, cell, length of consecutive repeats."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    new = F.when(F.col("cell") == F.lag("cell").over(own), 0).otherwise(1)
    return cell_pts.withColumn("_new", new).withColumn("run", F.sum("_new").over(own) - 1).groupBy(*TRIP, "run", "cell").agg(F.count("*").alias("length"))


def fill_route(cells: DataFrame, n: int) -> DataFrame:
    """King's moves between cells that are not neighbours, numbered anew."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    i, j = F.floor(F.col("cell") / n), F.col("cell") % n
    step = cells.withColumn("_i", i).withColumn("_j", j).withColumn("_di", F.lead("_i").over(own) - F.col("_i")).withColumn("_dj", F.lead("_j").over(own) - F.col("_j"))
    long = F.greatest(F.abs("_di"), F.abs("_dj"), F.lit(1))
    walk = step.withColumn("_t", F.explode(F.sequence(F.lit(0), F.coalesce(long, F.lit(1)).cast("int") - 1)))
    toward = lambda d: F.coalesce(F.signum(d) * F.least(F.col("_t"), F.abs(d)), F.lit(0))
    out = walk.withColumn("cell", ((F.col("_i") + toward(F.col("_di"))) * n + F.col("_j") + toward(F.col("_dj"))).cast("int"))
    return out.withColumn("seq", (F.row_number().over(W.partitionBy(*TRIP).orderBy("seq", "_t")) - 1).cast("long")).select(*TRIP, "seq", "cell")


def neighbours(spark: SparkSession, n: int, with_self: bool = True) -> DataFrame:
    """cell, other: cells at most one step apart in both directions."""
    offset = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    base = spark.range(n * n).select(F.col("id").cast("int").alias("cell")).withColumn("_a", offset).withColumn("_b", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    i, j = F.floor(F.col("cell") / n) + F.col("_a"), F.col("cell") % n + F.col("_b")
    out = base.withColumn("_i", i).withColumn("_j", j).where((F.col("_i").between(0, n - 1)) & (F.col("_j").between(0, n - 1)))
    out = out.select("cell", (F.col("_i") * n + F.col("_j")).cast("int").alias("other"))
    return out if with_self else out.where("cell != other")


def grid_steps(c1: Column, c2: Column, n: int) -> Column:
    """Cells on the shortest route; 2 for the same cell."""
    far = F.greatest(F.abs(F.floor(c1 / n) - F.floor(c2 / n)), F.abs(c1 % n - c2 % n))
    return (F.greatest(far, F.lit(1)) + 1).cast("int")


def cell_visits(cells: DataFrame, n: int) -> DataFrame:
    """Visits of every cell, 0 included."""
    every = cells.sparkSession.range(n * n).select(F.col("id").cast("int").alias("cell"))
    return every.join(cells.groupBy("cell").agg(F.count("*").alias("visits")), "cell", "left").fillna(0, ["visits"])


def nth_densest(cells: DataFrame, n: int, rank: int) -> DataFrame:
    """The cell with the rank-th most visits; ties in order of cells."""
    order = W.orderBy(F.desc("visits"), "cell")  # a row a cell
    return cell_visits(cells, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == rank)


def passes_through(cells: DataFrame) -> DataFrame:
    """Trips by cell."""
    return cells.select(*TRIP, "cell").distinct().groupBy("cell").agg(F.count("*").alias("trips"))


def density_weighted(cells: DataFrame) -> DataFrame:
    """Sum of 1 / length of the trip, by cell."""
    return cells.withColumn("_n", F.count("*").over(W.partitionBy(*TRIP))).groupBy("cell").agg(F.sum(1 / F.col("_n")).alias("density"))


def adaptive_split_trips(pts: DataFrame, g: Grid, densities: DataFrame, trips: int, eps: float, every: bool = True) -> DataFrame:
    """Sub-cells (cell, si, sj) of m x m in each cell, m = ceil(5 d / (N eps)), with the share of trips that touch each.

    densities: (cell, density), noisy; under 1e-4 counts as 0. pts: with cell. every: also those that no trip touches, of
    which there can be far more than points.
    """
    m = F.greatest(F.ceil(5 * F.when(F.col("density") < 1e-4, 0.0).otherwise(F.col("density")) / (trips * eps)), F.lit(1))
    split = densities.select("cell", m.cast("int").alias("m"))
    inside = pts.join(F.broadcast(split), "cell")  # n x n rows
    i, j = F.floor(F.col("cell") / g.n), F.col("cell") % g.n
    sub = lambda v, low, step, k: F.least(F.greatest(F.floor((v - (low + k * step)) / (step / F.col("m"))), F.lit(0)), F.col("m") - 1).cast("int")
    touched = inside.select(*TRIP, "cell", "m", sub(F.col("x"), g.x0, g.w, i).alias("si"), sub(F.col("y"), g.y0, g.h, j).alias("sj")).distinct().groupBy("cell", "m", "si", "sj").agg(F.count("*").alias("touching"))
    total = W.partitionBy("cell")
    out = touched.select("cell", "si", "sj", "m", "touching")
    if every:
        whole = split.withColumn("si", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("sj", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        out = whole.join(touched.drop("m").hint("merge"), ["cell", "si", "sj"], "left").fillna(0, ["touching"])
    return out.withColumn("share", F.coalesce(F.col("touching") / F.nullif(F.sum("touching").over(total), F.lit(0)), F.lit(0.0)))


def two_level_size(points: int) -> int:
    """Cells a side of the top level."""
    return min(60, int((points / 600) ** 0.5))


def adaptive_grid_two_level(densities: DataFrame, trips: int, k: int) -> DataFrame:
    """cell, m: m = ceil(sqrt(d / 200)) where d > 0.05 N / k^2, else 1."""
    d = F.col("density")
    return densities.select("cell", F.when(d > 0.05 * trips / (k * k), F.greatest(F.ceil(F.sqrt(d / 200)), F.lit(1))).otherwise(1).cast("int").alias("m"))


def insert_midpoints(pts: DataFrame, g: Grid, step_min: float = 15.0, most_steps: int = 2) -> DataFrame:
    """dataset, traj_id, seq, x, y, ts with points halfway in place and time between neighbours, again and again, until
    their cells are adjacent and their time bins at most `most_steps` apart; numbered anew. Moves back in time stay as they
    are. Bins count from midnight; an exact edge belongs to the bin before. No shuffle but the one that orders trips: a
    task gets its trips one after another and numbers their points as they come.
    """
    ready(pts.sparkSession)
    own = W.partitionBy(*TRIP).orderBy("seq")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    moves = pts.repartition(*TRIP).select(*TRIP, "seq", "x", "y", second.alias("t"), F.lead("x").over(own).alias("x2"), F.lead("y").over(own).alias("y2"), F.lead(second).over(own).alias("t2"), (F.row_number().over(own) == 1).alias("begins"))

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = lambda v, low, step: np.clip(np.floor((v - low) / step), 0, g.n - 1)
        bins = lambda t: np.maximum(np.ceil(np.mod(t, 86_400) / (step_min * 60)) - 1, 0)
        after = 0  # points so far of the trip that the batch before ended in
        for batch in batches:
            batch = batch.reset_index(drop=True)
            kept = batch[["dataset", "traj_id"]].assign(_row=np.arange(len(batch)), part=0.0, x=batch["x"], y=batch["y"], t=batch["t"])
            out, row = [kept], np.flatnonzero(batch["t2"].notna().to_numpy())
            a = batch[["x", "y", "t"]].to_numpy(float)[row]
            b = batch[["x2", "y2", "t2"]].to_numpy(float)[row]
            low, width = np.zeros(len(row)), np.ones(len(row))
            while len(row):
                far = (abs(column(a[:, 0], g.x0, g.w) - column(b[:, 0], g.x0, g.w)) > 1) | (abs(column(a[:, 1], g.y0, g.h) - column(b[:, 1], g.y0, g.h)) > 1)
                far |= abs(bins(a[:, 2]) - bins(b[:, 2])) > most_steps
                far &= (b[:, 2] > a[:, 2]) | (width < 1)
                # A move of no length whose time cannot be halved any more is as near as it gets.
                far &= (abs(a - b)[:, :2].max(axis=1, initial=0) > 1e-12) | (b[:, 2] - a[:, 2] > 1)
                row, a, b, low, width = row[far], a[far], b[far], low[far], width[far] / 2
                mid = (a + b) / 2
                mid[:, 2] = a[:, 2] + np.floor((b[:, 2] - a[:, 2]) / 2)
                out.append(batch[["dataset", "traj_id"]].iloc[row].assign(_row=row, part=low + width, x=mid[:, 0], y=mid[:, 1], t=mid[:, 2]))
                row, low, width = np.tile(row, 2), np.concatenate([low, low + width]), np.tile(width, 2)
                a, b = np.concatenate([a, mid]), np.concatenate([mid, b])
            if not len(batch):
                continue
            points = pd.concat(out, ignore_index=True).sort_values(["_row", "part"], ignore_index=True)
            new = batch["begins"].to_numpy(bool)[points["_row"]] & (points["part"] == 0).to_numpy()
            first = np.flatnonzero(new)
            goes_on = first[0] if len(first) else len(points)
            seq = np.arange(len(points)) - np.maximum.accumulate(np.where(new, np.arange(len(points)), 0))
            seq[:goes_on] += after
            after = int(seq[-1]) + 1
            yield points.assign(seq=seq).astype({"t": "int64"})[[*TRIP, "seq", "x", "y", "t"]]

    found = moves.sortWithinPartitions(*TRIP, "seq").mapInPandas(halve, "dataset string, traj_id long, seq long, x double, y double, t long")
    return found.select(*TRIP, "seq", "x", "y", F.timestamp_seconds("t").alias("ts"))


def space_time_states(pts: DataFrame) -> DataFrame:
    """(cell, t) without consecutive repeats, numbered, with the trip's length."""
    own = W.partitionBy(*TRIP).orderBy("seq")
    same = (F.col("cell") == F.lag("cell").over(own)) & (F.col("t") == F.lag("t").over(own))
    kept = pts.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same")
    return kept.select(*TRIP, (F.row_number().over(own) - 1).cast("long").alias("seq"), "cell", "t", F.count("*").over(W.partitionBy(*TRIP)).alias("length"))


def density_map(pts: DataFrame, g: Grid) -> DataFrame:
    """Points by (ix, iy)."""
    c = assign_cell(pts, g)
    return c.groupBy(F.floor(F.col("cell") / g.n).alias("ix"), (F.col("cell") % g.n).alias("iy")).agg(F.count("*").alias("points"))


def ranked_bounds(pts: DataFrame, rank: int) -> tuple[list[tuple], DataFrame]:
    """`rank` boxes, each of the trips that touch none of the boxes before; and the touching trips with their rank."""
    trips = pts.groupBy(*TRIP).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    boxes, touching = [], None
    for k in range(rank):
        b = trips.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).first()
        if b["x0"] is None:
            break
        boxes.append(tuple(b))
        on = (F.col("x0") == b["x0"]) | (F.col("x1") == b["x1"]) | (F.col("y0") == b["y0"]) | (F.col("y1") == b["y1"])
        own = trips.where(on).select(*TRIP, F.lit(k + 1).alias("rank"))
        touching = own if touching is None else touching.union(own)
        trips = trips.where(~on)
    return boxes, touching


def space_time_range(pts: DataFrame) -> DataFrame:
    """Earliest start and latest end, as times of day."""
    ends = pts.groupBy(*TRIP).agg(F.min_by("ts", "seq").alias("first"), F.max_by("ts", "seq").alias("last"))
    return ends.agg(F.min(F.date_format("first", "HH:mm:ss")).alias("start"), F.max(F.date_format("last", "HH:mm:ss")).alias("end"))


def subcells_in_box(subcells: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return subcells.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
