"""Synthetic trips drawn from models. Each walker depends on the seed and its own number alone."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.scalar import unit_hash
from wayveil.functions.tables import cut
from wayveil.functions.workers import ready
from wayveil.operators.attack import bayesian_attack, leaking_outliers, partial_sniffing
from wayveil.operators.grid import Grid, neighbours

#: The most bytes of a model that is sent to the walkers, and of what a task makes of it for one end.
MOST_BYTES = 1 << 30
#: Walkers of one end that go to one task.
WALKERS = 100_000


def _columns(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """The columns of a model of checked size, in the order of its rows' first two columns; numbers need 8 bytes each."""
    most = MOST_BYTES // (8 * len(columns))
    table = df.select(*columns).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"a model of over {most} entries is too large for the walkers")
    table = table.sort_by([(c, "ascending") for c in columns[:2]])
    return [table[c].to_numpy() for c in columns]


class _Moves:
    """Weights of moves between cells, row by row: only those that are there."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, cells: int, powers: int):
        if (powers + 1) * cells * 8 > MOST_BYTES:
            raise ValueError(f"{powers} steps over {cells} cells are too many for a task; take fewer powers")
        self.src, self.dst, self.w, self.cells, self.powers = src.astype(np.int64), dst.astype(np.int64), w.astype(float), cells, powers
        self.offsets = np.searchsorted(self.src, np.arange(cells + 1))
        self.end, self.known = -1, np.zeros((1, cells))

    def at(self, now: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Weights of single moves."""
        if not len(self.src):
            return np.zeros(now.shape)
        keys = self.src * self.cells + self.dst
        place = np.minimum(np.searchsorted(keys, now * self.cells + to), len(keys) - 1)
        return np.where((keys[place] == now * self.cells + to) & (to >= 0), self.w[place], 0.0)

    def reach(self, end: int, most: int) -> np.ndarray:
        """Row k: for every cell the weight of being at `end` after k moves. The last end's rows are kept and added to."""
        if end != self.end:
            self.end, self.known = end, np.zeros((1, self.cells))
            self.known[0, end] = 1
        rows = [self.known]
        for _ in range(min(most, self.powers) + 1 - len(self.known)):
            rows.append(np.bincount(self.src, self.w * rows[-1][-1][self.dst], self.cells)[None])
        self.known = np.concatenate(rows)
        return self.known


def _uniform(seed: int, ids: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) by seed, walker and step (the splitmix64 finaliser)."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + step * 0x2545F4914F6CDD1D) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _draw(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One column a row in proportion to the row's weights, which have a sum."""
    cum = np.cumsum(w, axis=1)
    return np.minimum((cum < (u * cum[:, -1])[:, None]).sum(axis=1), w.shape[1] - 1)


def _rows(df: DataFrame) -> list:
    """The rows of a model of checked size."""
    most = MOST_BYTES // 256
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a model of over {most} entries is too large for the walkers")
    return rows


def _trips(ids: np.ndarray, cells: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    at = np.arange(cells.shape[1])
    some = at < size[:, None]
    return pd.DataFrame({"dataset": "synthetic", "traj_id": np.repeat(ids, size), "seq": np.broadcast_to(at, cells.shape)[some].astype("int64"), "cell": cells[some].astype("int32")})


_TRIPS = "dataset string, traj_id long, seq long, cell int"


def _extra(family: str, mean: float, cap: int) -> np.ndarray:
    """Running shares of 0, 1, ... extra cells; what is above the cap counts as the cap."""
    k = np.arange(cap + 1)
    if family == "uniform":
        share = (k <= round(2 * mean)) / (round(2 * mean) + 1)
    elif family == "geometric":
        share = (mean / (mean + 1)) ** k / (mean + 1)
    else:
        share = np.exp(np.cumsum(np.concatenate([[-mean], np.log(mean) - np.log(k[1:])]))) if mean > 0 else (k == 0) * 1.0
    out = np.cumsum(share)
    out[-1] = 1.0
    return out


def synth_grid_markov(od: DataFrame, extra: DataFrame, matrix: DataFrame, n: int, trips: int, seed: int = 0, first_id: int = 0, powers: int = 100) -> DataFrame:
    """dataset, traj_id, seq, cell: start and end by od (src, dst, p); length = shortest route + a draw from the pair's
    family of extra lengths (src, dst, mean, family, cap), never above its cap; each middle cell among the neighbours, in
    proportion to the move's weight times the weight of reaching the end in the steps left. Where no neighbour has any
    weight, the walker takes one step straight to the end and goes on. More than `powers` steps left count as so many.

    Walkers are dealt by their end, a very common one over several tasks; those of a batch advance together, with one
    backward pass over the moves for each end. The model, a number a move, is sent to the tasks, of checked size.
    """
    spark = od.sparkSession
    ready(spark)
    lengths = {(r["src"], r["dst"]): (r["family"], r["mean"], r["cap"]) for r in _rows(extra)}
    moves = _Moves(*_columns(matrix, "src", "dst", "w"), n * n, powers)
    near = np.full((n * n, 8), -1)
    src, dst = _columns(neighbours(spark, n, with_self=False), "cell", "other")
    near[src, np.arange(len(src)) - np.searchsorted(src, src)] = dst
    beside = moves.at(np.arange(n * n)[:, None], near)

    def sized(pairs: np.ndarray, pick: np.ndarray, ids: np.ndarray) -> np.ndarray:
        a, b = pairs[pick].T
        size = np.maximum(np.maximum(abs(a // n - b // n), abs(a % n - b % n)), 1) + 1
        more = _uniform(seed, ids, 1)
        for k in np.unique(pick):
            own = pick == k
            if (found := lengths.get(tuple(pairs[k].tolist()))) is not None:
                size[own] += np.searchsorted(_extra(*found), more[own])
        return size

    def walks(model, start, end, size, ids):
        moves, near, beside = model
        reach = moves.reach(end, int(size.max()))
        cells = np.full((len(start), size.max()), -1)
        cells[:, 0] = start
        for i in range(1, int(size.max()) - 1):
            on = np.flatnonzero(i < size - 1)
            now, left = cells[on, i - 1], np.minimum(size[on] - i - 1, powers)
            options = near[now]
            w = beside[now] * reach[left[:, None], options]
            lost = w.sum(axis=1) < 1e-5
            w[lost, 0] = 1
            to = options[np.arange(len(on)), _draw(w, _uniform(seed, ids[on], i + 1))]
            straight = (now // n + np.sign(end // n - now // n)) * n + now % n + np.sign(end % n - now % n)
            cells[on, i] = np.where(lost, straight, to)
        cells[np.arange(len(start)), size - 1] = end
        return cells, size

    return _walked(od, first_id, trips, seed, sized, walks, (moves, near, beside))


def synth_median_length(od: DataFrame, lengths: DataFrame, matrix: DataFrame, n: int, trips: int, seed: int = 0, powers: int = 200) -> DataFrame:
    """As synth_grid_markov, with exponential lengths about a pair's median and middle cells anywhere; dead ends are skipped.

    While more than `powers` steps are left, that power of the matrix stands for the higher ones.
    """
    ready(od.sparkSession)
    src, dst, length = _columns(lengths, "src", "dst", "length")
    keys = src.astype(np.int64) * n * n + dst
    moves = _Moves(*_columns(matrix, "src", "dst", "w"), n * n, powers)

    def sized(pairs: np.ndarray, pick: np.ndarray, ids: np.ndarray) -> np.ndarray:
        asked = pairs[pick, 0] * n * n + pairs[pick, 1]
        place = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        half = np.where(keys[place] == asked, length[place], 2).astype(float) if len(keys) else np.full(len(ids), 2.0)
        return np.maximum(2, np.rint(-np.log(_uniform(seed, ids, 1)) * half / np.log(2)).astype(int))

    def walks(moves, start, end, size, ids):
        reach = moves.reach(end, int(size.max()))
        cells, used = np.full((len(start), size.max()), -1), np.ones(len(start), int)
        cells[:, 0] = start
        for i in range(1, int(size.max()) - 1):
            on = np.flatnonzero(i < size - 1)
            now = cells[on, used[on] - 1]
            # The moves that there are from every walker's cell, one after the other.
            each = np.diff(moves.offsets)[now]
            who = np.repeat(np.arange(len(on)), each)
            at = np.arange(len(who)) + np.repeat(moves.offsets[now] - np.cumsum(each) + each, each)
            w = moves.w[at] * reach[np.minimum(size[on] - i - 1, powers)[who], moves.dst[at]]
            who, to, w = who[w > 0], moves.dst[at][w > 0], w[w > 0]
            some, first = np.unique(who, return_index=True)
            if len(some):
                cum, total = np.cumsum(w), np.add.reduceat(w, first)
                last = np.append(first[1:], len(w)) - 1
                place = np.searchsorted(cum, cum[first] - w[first] + _uniform(seed, ids[on[some]], i + 1) * total)
                cells[on[some], used[on[some]]] = to[np.clip(place, first, last)]
                used[on[some]] += 1
        cells[np.arange(len(start)), used] = end
        return cells, used + 1

    return _walked(od, 0, trips, seed, sized, walks, moves)


def _walked(od: DataFrame, first_id: int, trips: int, seed: int, sized, walks, model) -> DataFrame:
    """Trips of walkers with a pair of ends each, by od (src, dst, p). sized: their lengths; walks: their cells, for one end."""
    spark = od.sparkSession
    src, dst, p = _columns(od, "src", "dst", "p")
    pairs, cum = np.stack([src, dst], axis=1).astype(np.int64), np.cumsum(p)
    tasks = np.maximum(1, np.ceil(np.bincount(dst, p) * trips / max(p.sum(), 1e-300) / WALKERS)).astype(np.int64) if len(p) else np.ones(1, np.int64)
    sent = spark.sparkContext.broadcast((pairs, cum, tasks, model))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, cum, tasks, _ = sent.value
        for batch in batches:
            ids = batch["id"].to_numpy() if len(cum) else np.zeros(0, np.int64)
            pick = np.minimum(np.searchsorted(cum, _uniform(seed, ids, 0) * (cum[-1] if len(cum) else 0)), len(cum) - 1)
            a, b = pairs[pick].T if len(ids) else (ids, ids)
            yield pd.DataFrame({"id": ids, "start": a, "end": b, "size": sized(pairs, pick, ids) if len(ids) else ids, "task": ids % tasks[b] if len(ids) else ids})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value[3]
        for batch in batches:
            ids, start, ends, size = (batch[c].to_numpy() for c in ("id", "start", "end", "size"))
            for end in np.unique(ends):
                own = np.flatnonzero(ends == end)
                yield _trips(ids[own], *walks(model, start[own], int(end), size[own], ids[own]))

    drawn = spark.range(first_id, first_id + trips).mapInPandas(draw, "id long, start long, end long, size long, task long")
    return drawn.repartition("end", "task").sortWithinPartitions("end").mapInPandas(walk, _TRIPS)


def synth_count_split(starts: DataFrame, moves: DataFrame, max_len: int = 125, steps: int = 5_000) -> DataFrame:
    """(cells, copies): each prefix's count is split over its next states by floors of the largest total that fits.

    starts: (cell, n). moves: (src, dst, p), the rest of 1 being the end. Deterministic. A task splits up to `steps`
    prefixes below each row, the shortest first, and hands the others back as rows, which are dealt anew: the trips of one
    start spread over all tasks after the first round, and a round's rows reach `steps` times as many prefixes.
    """
    spark = starts.sparkSession
    ready(spark)
    table: dict[int, list] = {}
    for r in _rows(moves):
        table.setdefault(r["src"], []).append((r["dst"], r["p"]))
    sent = spark.sparkContext.broadcast({k: sorted(v) for k, v in table.items()})

    def split(c: int, shares: list) -> list[int]:
        total = sum(s for _, s in shares)
        for more in range(100, -1, -1):
            parts = [int(s * (c + more) + 1e-9) for _, s in shares]
            if sum(parts) <= c and (more == 0 or total > 0):
                return parts
        return [int(s * c + 1e-9) for _, s in shares]

    def below(prefix: list[int], copies: int) -> Iterator[tuple[list[int], int, bool]]:
        """Ended trips, and prefixes that are still to be split."""
        line, left = deque([(prefix, copies)]), steps
        while line and left:
            left -= 1
            prefix, c = line.popleft()
            shares = sent.value.get(prefix[-1], []) if len(prefix) < max_len else []
            parts = split(c, shares)
            rest = c - sum(parts)
            if rest > 0:
                yield prefix if len(prefix) > 1 else prefix * 2, rest, False
            line.extend(([*prefix, d], k) for (d, _), k in zip(shares, parts) if k > 0)
        yield from ((p, c, True) for p, c in line)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for cells, copies in zip(batch["cells"], batch["copies"]):
                out += below([int(x) for x in cells], int(copies))
                if len(out) >= 4 * steps:
                    yield pd.DataFrame(out, columns=["cells", "copies", "open"])
                    out = []
        yield pd.DataFrame(out, columns=["cells", "copies", "open"])

    ended, todo = None, starts.select(F.array(F.col("cell").cast("int")).alias("cells"), F.col("n").cast("long").alias("copies"))
    while ended is None or not todo.isEmpty():
        # Dealt by their own hash, so that a task that is run again gets the same rows.
        dealt = todo.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("cells", "copies"))
        done = cut(dealt.mapInPandas(walk, "cells array<int>, copies long, open boolean"))
        new, todo = done.where("not open").drop("open"), done.where("open").drop("open")
        ended = new if ended is None else ended.unionByName(new)
    return ended


def realise_points(cells: DataFrame, g: Grid, seed: int = 0, how: str = "uniform", subs: DataFrame | None = None, start: str = "00:00:00", step_min: float = 15.0, date: str = "2009-01-01") -> DataFrame:
    """Adds x, y to cells by a hash of the point. how:

    uniform: anywhere in the cell. adaptive: in a sub-cell of it, by subs (cell, si, sj, m, share); a cell without shares
    is one. subcell: cell is a state of subs (cell, x0, x1, y0, y1), and a trip of one state gets a second point. centre:
    the middle of the cell, and ts, the middle of the time bin t.
    """
    u = lambda k: unit_hash(F.col("traj_id"), F.col("seq"), F.lit(k), seed=seed)
    i, j = F.floor(F.col("cell") / g.n), F.col("cell") % g.n
    if how == "uniform":
        return cells.withColumn("x", g.x0 + (i + u(0)) * g.w).withColumn("y", g.y0 + (j + u(1)) * g.h)
    if how == "centre":
        second = (F.unix_timestamp(F.lit(f"{date} {start}").cast("timestamp")) + F.lit(step_min * 60) * (F.col("t") + 0.5)).cast("long")
        return cells.withColumn("x", g.x0 + (i + 0.5) * g.w).withColumn("y", g.y0 + (j + 0.5) * g.h).withColumn("ts", F.timestamp_seconds(second))
    if how == "adaptive":
        own = F.array_sort(F.collect_list(F.struct("si", "sj", "m", "share")))
        shares = subs.groupBy("cell").agg(own.alias("_subs"))  # a row a cell
        running = F.aggregate("_subs", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("struct<si:int,sj:int,m:int,share:double>").alias("at")), lambda t, s: F.struct((t["sum"] + s["share"]).alias("sum"), F.when(t["at"].isNull() & (s["share"] > 0) & (t["sum"] + s["share"] >= F.col("_u")), s).otherwise(t["at"]).alias("at")), lambda t: t["at"])
        placed = cells.join(F.broadcast(shares), "cell", "left").withColumn("_u", u(2) * (1 - 1e-12)).withColumn("_at", running)
        m, si, sj = F.coalesce(F.col("_at.m"), F.lit(1)), F.coalesce(F.col("_at.si"), F.lit(0)), F.coalesce(F.col("_at.sj"), F.lit(0))
        out = placed.withColumn("x", g.x0 + (i + (si + u(0)) / m) * g.w).withColumn("y", g.y0 + (j + (sj + u(1)) / m) * g.h)
        return out.select(*cells.columns, "x", "y")
    counted = cells.withColumn("_n", F.count("*").over(W.partitionBy("dataset", "traj_id")))
    twice = counted.withColumn("seq", F.explode(F.when(F.col("_n") == 1, F.array(F.col("seq"), F.col("seq") + 1)).otherwise(F.array("seq"))))
    boxed = twice.join(subs.select("cell", "x0", "x1", "y0", "y1"), "cell")
    return boxed.select(*cells.columns, (F.col("x0") + u(0) * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + u(1) * (F.col("y1") - F.col("y0"))).alias("y"))


def _fresh_ids(synthetic: DataFrame) -> int:
    return (synthetic.agg(F.max("traj_id")).first()[0] or 0) + 1


def defend_bayesian(o_cells: DataFrame, synthetic: DataFrame, zone: int, theta: float, generate, rounds: int = 100) -> DataFrame:
    """The synthetic cells, with all trips through the zone drawn anew until they give nothing away (K3).

    generate: (count, round, first id) -> cells of new trips, as synth_grid_markov gives them. An error after the rounds.
    """
    synthetic = cut(synthetic)
    for k in range(rounds):
        if bayesian_attack(o_cells, synthetic, zone, theta).select("passes").first()[0]:
            return synthetic
        bad = cut(synthetic.where(F.col("cell") == zone).select("traj_id").distinct())
        synthetic = cut(synthetic.join(bad, "traj_id", "left_anti").unionByName(generate(bad.count(), k, _fresh_ids(synthetic))))
    raise ValueError(f"the trips through the zone still differ by more than {theta} after {rounds} rounds")


def _refilled(kept: DataFrame, missing: int, first: int, generate, avoid: list[int], rounds: int) -> DataFrame:
    """kept (points with cell) and `missing` new trips, with ids from `first` on, that avoid some cells: drawn in rounds
    until there are enough. A round draws as many as the share of good ones in the round before asks for, and the first good
    ones by id are taken, so rounds do not grow with the trips."""
    asked = missing
    for k in range(rounds):
        if not missing:
            return kept
        new = cut(generate(asked, k, first))
        good = new.join(new.where(F.col("cell").isin(avoid)).select("traj_id").distinct(), "traj_id", "left_anti")
        ids = cut(good.select("traj_id").distinct())
        found = ids.count()
        if found > missing:
            good = good.join(ids.orderBy("traj_id").limit(missing), "traj_id", "left_semi")
        first, kept = first + asked, cut(kept.unionByName(good.select(*kept.columns)))
        missing -= min(found, missing)
        asked = math.ceil(1.1 * missing * min(asked / max(found, 1), 100.0)) + 1
    if missing:
        raise ValueError(f"{missing} new trips still meet the avoided cells after {rounds} rounds")
    return kept


def defend_sniffing(o_pts: DataFrame, synthetic: DataFrame, sniff: int, sensitive: int, generate, threshold: int = 5, tol: float = 1.0, rounds: int = 100) -> DataFrame:
    """The synthetic points (with cell), with the trips that K4 finds leaking replaced by trips that avoid both zones."""
    synthetic = cut(synthetic)
    leaking = cut(partial_sniffing(o_pts, synthetic, sniff, sensitive, threshold, tol).where("fails").select(F.col("j").alias("traj_id")).distinct())
    return _refilled(cut(synthetic.join(leaking, "traj_id", "left_anti")), leaking.count(), _fresh_ids(synthetic), generate, [sniff, sensitive], rounds)


def defend_outliers(o_pts: DataFrame, synthetic: DataFrame, generate, **parameters) -> DataFrame:
    """The synthetic points (with cell), with the outliers that K11 finds linkable replaced by new trips."""
    synthetic = cut(synthetic)
    linkable = cut(leaking_outliers(o_pts, synthetic, **parameters)[1].distinct())
    return _refilled(cut(synthetic.join(linkable, "traj_id", "left_anti")), linkable.count(), _fresh_ids(synthetic), generate, [], 1)
