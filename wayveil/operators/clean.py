"""Cleaning, splitting and selecting trips. Points: dataset, traj_id, seq, x, y, ts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.scalar import point_time
from wayveil.functions.tables import cut, ranked
from wayveil.functions.workers import ready

TRIP = ["dataset", "traj_id"]


def _own(order: str = "seq"):
    return W.partitionBy(*TRIP).orderBy(order)


#: Points of one log that a task walks at a time.
BLOCK = 1 << 16


def _walked(raw: DataFrame, key: list[str], order: list, walk, counter: str, block: int) -> DataFrame:
    """The rows that walk(log, last) keeps of each log, with a running counter.

    walk: (sorted log, last kept x, y, t or None) -> (kept rows with `counter` from 0, the new last, the counter's end).
    A log of up to `block` points is one group. A longer one is cut into blocks by places in the order; each block is
    walked at once from a guess of the point kept before it, which is what the block before it ended with in the last
    round, and again while that guess is not what the block before it ends with now. Two walks soon keep the same point,
    so two rounds are common; the first blocks of a log are right after as many rounds, so the rounds end. States are a
    row a block. Then every block is walked from its right state.
    """
    spark = raw.sparkSession
    ready(spark)
    types = {f.name: f.dataType.simpleString() for f in raw.schema}
    out = ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", {counter} long"
    keys = ", ".join(f"`{c}` {types[c]}" for c in key)
    sizes = cut(raw.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]))
    whole = lambda df: df.groupBy(*key).applyInPandas(lambda log: walk(log, None)[0], out)
    if sizes.isEmpty():
        return whole(raw)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    placed = ranked(raw.join(sizes, same, "left_semi"), [*key, *order], "_place")
    blocks = cut(placed.withColumn("_block", F.floor(F.col("_place") / block)).drop("_place"))
    unit = [*key, "_block"]
    before = W.partitionBy(*key).orderBy("_block")
    state = "has boolean, lx double, ly double, lt double"

    def last(row) -> tuple | None:
        return (row.lx, row.ly, row.lt) if row.has else None

    def end(log: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(log) or not len(states):
            return pd.DataFrame(columns=[*unit, *[f"{p}{c}" for p in "io" for c in ("has", "lx", "ly", "lt")], "n"])
        row = next(states.itertuples())
        _, now, n = walk(log.drop(columns="_block"), last(row))
        ids = states[unit].iloc[:1].reset_index(drop=True)
        ids[["ihas", "ilx", "ily", "ilt"]] = [[row.has, row.lx, row.ly, row.lt]]
        ids[["ohas", "olx", "oly", "olt"]] = [[now is not None, *(now or (None, None, None))]]
        return ids.assign(n=n)

    def rows(log: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        kept = walk(log.drop(columns="_block"), last(next(states.itertuples())))[0]
        return kept.assign(**{counter: kept[counter] + states["before"].iloc[0]})

    fields = ["has", "lx", "ly", "lt"]
    ends = f"{keys}, _block long, " + ", ".join(f"{p}{f}" for p in "io" for f in state.split(", ")) + ", n long"
    todo = blocks.select(*unit).distinct().selectExpr(*[f"`{c}`" for c in unit], "false AS has", *[f"CAST(NULL AS double) AS {c}" for c in fields[1:]])
    known = None
    while True:
        todo = cut(todo)
        if todo.isEmpty():
            break
        some = blocks.join(todo.select("_block").distinct(), "_block", "left_semi")
        new = some.groupBy(*unit).cogroup(todo.groupBy(*unit)).applyInPandas(end, ends)
        if known is not None:
            # What was walked before, but for the blocks walked anew.
            newest = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            new = newest.withColumn("_top", F.max("_new").over(W.partitionBy(*unit))).where("_new = _top").drop("_new", "_top")
        known = cut(new)
        fits = F.lit(True)
        told = known
        for c in fields:
            told = told.withColumn(f"_{c}", F.lag(f"o{c}").over(before))
            fits = fits & F.col(f"i{c}").eqNullSafe(F.coalesce(F.col(f"_{c}"), F.lit(False)) if c == "has" else F.col(f"_{c}"))
        todo = told.where(~fits).select(*unit, *[F.col(f"_{c}").alias(c) for c in fields])
    total = F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    right = known.select(*unit, *[F.col(f"i{c}").alias(c) for c in fields], total.alias("before"))
    long_ones = blocks.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(rows, out)
    return whole(raw.join(sizes, same, "left_anti")).unionByName(long_ones)


def clean_split(raw: DataFrame, key: list[str], min_distance: float = 1e-4, max_speed: float = 40.0, max_time: float = 900.0, max_distance: float | None = 0.05, split_first: bool = False, bad_if_no_time: bool = False, splits: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds `part` and drops bad points, comparing each with the last point that was kept.

    split_first: test for a split (time gap only) before speed. bad_if_no_time: no time passed counts as too fast.
    A group is one raw log of any length; filter by box and date first.
    """

    def walk(log: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple | None, int]:
        log = log.sort_values(["ts", "seq"], kind="stable")
        x, y, t = log["x"].to_numpy(), log["y"].to_numpy(), log["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        keep, part, now = np.zeros(len(log), bool), np.zeros(len(log), np.int64), 0
        for k in range(len(log)):
            if last is not None:
                gap, far = t[k] - last[2], float(np.hypot(x[k] - last[0], y[k] - last[1]))
                if far < min_distance:
                    continue
                parted = splits and (gap > max_time or (max_distance is not None and not split_first and far > max_distance))
                fast = (gap > 0 and far * 111_000 / gap > max_speed) or (gap <= 0 and bad_if_no_time)
                if fast and not (split_first and parted):
                    continue
                now += parted
            keep[k], part[k], last = True, now, (float(x[k]), float(y[k]), float(t[k]))
        return log.assign(part=part)[keep], last, int(now)

    kept = _walked(raw, key, [F.col("ts").asc_nulls_last(), "seq"], walk, "part", block)
    return kept.withColumn("part", F.col("part").cast("int"))


def clean_porto(raw: DataFrame, key: list[str], left: float, right: float, bottom: float, top: float, min_distance: float = 1e-4, max_speed: float = 40.0, step_s: int = 15, block: int = BLOCK) -> DataFrame:
    """Lines sampled at a fixed rate (key, seq, x, y, start): drops noise, leaps and points outside the box; adds ts.

    A point is compared with the last one that was kept. Noise and leaps take their time with them; a point outside the
    box takes none, so the times of what follows move up. A line may be of any length.
    """

    def walk(line: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple | None, int]:
        line = line.sort_values("seq", kind="stable")
        x, y = line["x"].to_numpy(), line["y"].to_numpy()
        keep, at, passed = np.zeros(len(line), bool), np.zeros(len(line), np.int64), 0
        for k in range(len(line)):
            far = float(np.hypot(x[k] - last[0], y[k] - last[1])) if last is not None else None
            bad = far is not None and (far < min_distance or far * 111_000 / step_s > max_speed)
            if not bad and left <= x[k] <= right and bottom <= y[k] <= top:
                keep[k], at[k], last = True, passed, (float(x[k]), float(y[k]), 0.0)
            elif not bad:
                continue
            passed += 1
        return line.assign(at=at)[keep], last, passed

    kept = _walked(raw, key, ["seq"], walk, "at", block)
    return kept.withColumn("ts", point_time(F.col("start"), F.col("at"), step_s)).drop("at")


def take_prefix(pts: DataFrame, left: float, right: float, bottom: float, top: float, max_gap_s: int = 6500, min_points: int = 3) -> DataFrame:
    """From the first point inside the box to the first one outside, or to a gap (time of day, modulo a day)."""
    own = _own()
    inside = F.col("x").between(left, right) & F.col("y").between(bottom, top)
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    marked = pts.withColumn("_in", inside).withColumn("_first", F.min(F.when(inside, F.col("seq"))).over(W.partitionBy(*TRIP))).where("seq >= _first")
    gap = F.pmod(seconds - F.lag(seconds).over(own), F.lit(86_400)) > max_gap_s
    stop = marked.withColumn("_break", ~F.col("_in") | F.coalesce(gap, F.lit(False)))
    stop = stop.withColumn("_stop", F.min(F.when(F.col("_break"), F.col("seq"))).over(W.partitionBy(*TRIP))).where("_stop is null or seq < _stop")
    return stop.withColumn("_n", F.count("*").over(W.partitionBy(*TRIP))).where(F.col("_n") >= min_points).drop("_in", "_first", "_break", "_stop", "_n")


def keep_meaningful(pts: DataFrame, min_points: int = 3, min_dist: float = 0.01, mode: str = "displacement") -> DataFrame:
    """Trips with enough points whose displacement, or path, is longer than min_dist."""
    step = F.hypot(F.col("x") - F.lag("x").over(_own()), F.col("y") - F.lag("y").over(_own()))
    stats = pts.withColumn("_step", step).groupBy(*TRIP).agg(
        F.count("*").alias("n"), F.sum("_step").alias("path"),
        F.hypot(F.max_by("x", "seq") - F.min_by("x", "seq"), F.max_by("y", "seq") - F.min_by("y", "seq")).alias("displacement"),
    )
    return pts.join(stats.where((F.col("n") >= min_points) & (F.col(mode) > min_dist)).select(*TRIP), TRIP, "left_semi")


def invalid_trips(pts: DataFrame) -> DataFrame:
    """Trips with a missing time or one that decreases."""
    bad = F.col("ts").isNull() | F.coalesce(F.col("ts") < F.lag("ts").over(_own()), F.lit(False))
    return pts.withColumn("_bad", bad).groupBy(*TRIP).agg(F.max("_bad").alias("bad")).where("bad").select(*TRIP)


def drop_invalid(rows: DataFrame, trips: DataFrame) -> DataFrame:
    return rows.join(trips, TRIP, "left_anti")


def drop_backwards(pts: DataFrame, min_points: int = 2) -> DataFrame:
    """Points later than all before them; then trips that still have enough points."""
    later = F.max("ts").over(_own().rowsBetween(W.unboundedPreceding, -1))
    kept = pts.withColumn("_before", later).where("_before is null or ts > _before").drop("_before")
    return kept.withColumn("_n", F.count("*").over(W.partitionBy(*TRIP))).where(F.col("_n") >= min_points).drop("_n")


def drop_repeats(pts: DataFrame) -> DataFrame:
    same = (F.col("x") == F.lag("x").over(_own())) & (F.col("y") == F.lag("y").over(_own()))
    return pts.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


def cut_space_time(pts: DataFrame, inside, max_dwell_s: float) -> DataFrame:
    """From the first point inside, up to the first outside or until a stay in one cell gets too long. Points with `cell`."""
    own = _own()
    started = pts.withColumn("_in", inside).withColumn("_first", F.min(F.when(inside, F.col("seq"))).over(W.partitionBy(*TRIP))).where("seq >= _first")
    run = started.withColumn("_run", F.sum(F.when(F.col("cell").eqNullSafe(F.lag("cell").over(own)), 0).otherwise(1)).over(own))
    dwell = F.unix_timestamp("ts") - F.min(F.unix_timestamp("ts")).over(W.partitionBy(*TRIP, "_run"))
    stop = run.withColumn("_break", ~F.col("_in") | (dwell > max_dwell_s)).withColumn("_stop", F.min(F.when(F.col("_break"), F.col("seq"))).over(W.partitionBy(*TRIP)))
    return stop.where("_stop is null or seq < _stop").drop("_in", "_first", "_run", "_break", "_stop")


def sample_trips(pts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n trips, the same ones however the data are partitioned; an error if there are fewer."""
    ids = pts.select(*TRIP).distinct()
    some = ids.orderBy(F.xxhash64(F.lit(seed), *TRIP), *TRIP).limit(n)
    if some.count() < n:
        raise ValueError(f"fewer than {n} trips")
    return pts.join(some, TRIP, "left_semi")


def head_trips(pts: DataFrame, n: int) -> DataFrame:
    """The first n trips by id, renumbered from 0."""
    first = pts.select("traj_id").distinct().orderBy("traj_id").limit(n)
    ranked = first.select("traj_id", (F.row_number().over(W.orderBy("traj_id")) - 1).alias("_new"))  # n rows
    return pts.join(ranked, "traj_id").withColumn("traj_id", F.col("_new").cast("long")).drop("_new")


def id_range(pts: DataFrame, low: int, high: int) -> DataFrame:
    return pts.where(F.col("traj_id").between(low, high))


#: Pieces of stretches that are weighed at a time.
PIECES = 1 << 15


def mdl_simplify(pts: DataFrame) -> DataFrame:
    """Characteristic points: a stretch grows while its perpendicular and angular cost does not exceed 0 bits.

    The trips of a batch are walked side by side, a point a round; stretches of one length are weighed at once.
    """
    ready(pts.sparkSession)

    def walk(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(_characteristic(xs, ys))

    rest = [c for c in pts.columns if c not in TRIP]
    trips = pts.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c != "seq"]))).alias("p"))
    side = lambda v: F.transform("p", lambda q: q[v].cast("double"))
    kept = trips.withColumn("k", F.pandas_udf(walk, "array<int>")(side("x"), side("y")))
    return kept.select(*TRIP, F.explode(F.transform("k", lambda i: F.element_at("p", i + 1))).alias("q")).select(*TRIP, *[f"q.{c}" for c in rest]).select(*pts.columns)


def _characteristic(xs, ys) -> list[np.ndarray]:
    """The places of each trip's characteristic points, in order; the first and the last are among them."""
    n = np.array([len(x) for x in xs], np.int64)
    if not n.sum():
        return [np.zeros(0, np.int64) for _ in n]
    p = np.column_stack([np.concatenate(list(v)).astype(float) for v in (xs, ys)])
    first = np.concatenate([[0], np.cumsum(n)])
    keep, start = np.zeros(len(p), bool), np.zeros(len(n), np.int64)
    keep[first[:-1][n > 0]] = keep[first[1:][n > 0] - 1] = True
    longest_first = np.argsort(-n, kind="stable")
    upto = np.searchsorted(-n[longest_first], -np.arange(n.max() + 1))  # so many trips have more than k points
    for k in range(2, n.max()):
        live = longest_first[: upto[k]]
        size = k - start[live]
        for length in np.unique(size[size > 1]):
            some, step = live[size == length], max(1, PIECES // length)
            for at in range(0, len(some), step):
                now = some[at : at + step]
                over = now[_bits(p, first[now] + start[now], length) > 0]
                keep[first[over] + k - 1] = True
                start[over] = k - 1
    places = np.flatnonzero(keep)
    ends = np.searchsorted(places, first)
    return [places[ends[t] : ends[t + 1]] - first[t] for t in range(len(n))]


def _bits(p: np.ndarray, i: np.ndarray, length: int) -> np.ndarray:
    """The cost of stretches from the points i on, all of `length` steps."""
    at = i[:, None] + np.arange(length)
    a, b, p0, p1 = p[at], p[at + 1], p[i][:, None], p[i + length][:, None]
    whole, piece = np.broadcast_to(p1 - p0, a.shape), b - a
    skip = (a == p0).all(axis=2) & (b == p1).all(axis=2)
    longer = (np.hypot(whole[..., 0], whole[..., 1]) > np.hypot(piece[..., 0], piece[..., 1]))[..., None]
    s0, base = np.where(longer, p0, a), np.where(longer, whole, piece)
    q0, q1 = np.where(longer, a, p0), np.where(longer, b, p1)
    other = q1 - q0
    norm = (base * base).sum(axis=2)
    safe = np.where(norm == 0, 1, norm)
    off = lambda q: np.linalg.norm(q - s0 - (((q - s0) * base).sum(axis=2) / safe)[..., None] * base, axis=2)
    d0, d1 = off(q0), off(q1)
    across = np.where(norm == 0, np.spacing(1.0), np.where(d0 + d1 == 0, 0, (d0**2 + d1**2) / np.where(d0 + d1 == 0, 1, d0 + d1)))
    size, dot = np.linalg.norm(other, axis=2), (base * other).sum(axis=2)
    product = np.sqrt(norm) * size
    cosine = dot / np.where(product == 0, 1, product)
    turn = np.where((base == other).all(axis=2), 0, np.where(dot <= 0, size, size * np.sqrt(np.maximum(1 - cosine**2, 0))))
    total = np.zeros(len(i))
    for part in (across, turn):
        v = part.sum(axis=1)
        for r in np.flatnonzero(skip.any(axis=1)):  # a step that is the whole stretch: sums without it
            v[r] = part[r][~skip[r]].sum()
        total += np.log2(v, where=v > 0, out=np.zeros(len(v)))
    return total
