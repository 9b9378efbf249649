"""The adaptive grid of two levels: states, their neighbours and paths, calibrated trips, and walks over them.

A state is a sub-cell: state, cell (of the top grid), row and col (the cell's place, row along x), m (sub-cells a side),
si, sj (place inside the cell) and its box.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.tables import cut, ranked
from wayveil.functions.workers import ready, tasks
from wayveil.operators.grid import Grid, adaptive_grid_two_level, assign_all_closed, assign_cell, density_weighted, two_level_size, uniform_grid
from wayveil.operators.model import clip_round, laplace, queue_minus
from wayveil.operators.paths import Lattice

#: The most bytes of each part of a model that is sent to the tasks.
MOST_BYTES = 1 << 28


def states_of(top: Grid, split: DataFrame) -> DataFrame:
    """The states of a top grid whose cells are split into m x m: split has (cell, m)."""
    m, k = F.col("m"), F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    subs = split.select("cell", F.col("m").cast("int").alias("m")).withColumn("si", k).withColumn("sj", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    row, col = F.floor(F.col("cell") / top.n).cast("int"), (F.col("cell") % top.n).cast("int")
    box = lambda low, step, at, s, more: (F.lit(low) + F.lit(step) * (at + (s + more) / m))
    out = subs.withColumn("row", row).withColumn("col", col)
    out = out.withColumn("x0", box(top.x0, top.w, F.col("row"), F.col("si"), 0)).withColumn("x1", box(top.x0, top.w, F.col("row"), F.col("si"), 1))
    out = out.withColumn("y0", box(top.y0, top.h, F.col("col"), F.col("sj"), 0)).withColumn("y1", box(top.y0, top.h, F.col("col"), F.col("sj"), 1))
    return ranked(out, ["cell", "si", "sj"], "state").withColumn("state", F.col("state").cast("int"))


def two_level_states(pts: DataFrame, top: Grid | None = None, eps: float | None = None, seed: int = 0) -> DataFrame:
    """States of the grid whose top level has two_level_size cells a side and whose cells are split by their density.

    eps: noise on the densities, whose negatives are taken from the smallest positives. top: another top level.
    """
    if top is None:
        size = two_level_size(pts.count())
        if size < 2:
            raise ValueError("too few points for two levels")
        b = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
        top = Grid(b["x0"], b["x1"], b["y0"], b["y1"], size)
    seen = density_weighted(assign_cell(pts, top, "snap_lower"))
    every = uniform_grid(pts.sparkSession, top).select("cell").join(seen, "cell", "left").fillna(0.0, ["density"])
    if eps is not None:
        every = queue_minus(every.withColumn("density", F.col("density") + laplace([F.col("cell")], eps, seed=seed)).withColumn("_all", F.lit(0)), ["_all"], "density", "cell").drop("_all")
    trips = pts.select("dataset", "traj_id").distinct().count()
    return cut(states_of(top, adaptive_grid_two_level(every, trips, top.n)))


def sqrt_states(pts: DataFrame, top: Grid, beta: float, eps: float | None = None, seed: int = 0) -> DataFrame:
    """States of a top grid whose cells are split into max(1, rint(sqrt(density * beta))) a side."""
    every = uniform_grid(pts.sparkSession, top).select("cell").join(density_weighted(assign_cell(pts, top, "snap_lower")), "cell", "left").fillna(0.0, ["density"])
    noisy = every if eps is None else every.withColumn("density", F.col("density") + laplace([F.col("cell")], eps, seed=seed))
    m = F.greatest(F.rint(F.sqrt(clip_round(F.col("density")) * beta)), F.lit(1.0)).cast("int")
    return cut(states_of(top, noisy.select("cell", m.alias("m"))))


def assign_states(pts: DataFrame, top: Grid, states: DataFrame, closed: bool = False) -> DataFrame:
    """Adds state: a point on an inner edge belongs to the lower one. closed: a row for every closed state that holds it."""
    cells = states.select("cell", "m", "row", "col").distinct()  # n x n rows
    up = lambda v, low, step: F.floor((v - low) / step).cast("int")
    down = lambda v, low, step: (F.ceil((v - low) / step) - 1).cast("int")
    bound = lambda k: F.least(F.greatest(k, F.lit(0)), F.col("m") - 1)
    at = (assign_all_closed(pts, top) if closed else assign_cell(pts, top, "snap_lower")).join(F.broadcast(cells), "cell")
    x, y = (F.col("x"), top.x0 + F.col("row") * top.w, top.w / F.col("m")), (F.col("y"), top.y0 + F.col("col") * top.h, top.h / F.col("m"))
    if closed:
        # The places beside the computed one as well; the states' own boxes decide.
        around = lambda v: F.explode(F.array_distinct(F.array(bound(up(*v) - 1), bound(up(*v)), bound(up(*v) + 1))))
        at = at.withColumn("si", around(x)).withColumn("sj", around(y)).join(states.select("cell", "si", "sj", "state", "x0", "x1", "y0", "y1"), ["cell", "si", "sj"])
        return at.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select(*pts.columns, "state")
    # The division can round over an edge, so the states' own edges, as states_of takes them, decide.
    edge = lambda low, step, place, k: F.lit(low) + F.lit(step) * (F.col(place) + k / F.col("m"))
    moved = lambda v, k, low, step, place: F.when((F.col(k) > 0) & (F.col(v) <= edge(low, step, place, F.col(k))), F.col(k) - 1).when((F.col(k) < F.col("m") - 1) & (F.col(v) > edge(low, step, place, F.col(k) + 1)), F.col(k) + 1).otherwise(F.col(k)).cast("int")
    at = at.withColumn("si", bound(down(*x))).withColumn("sj", bound(down(*y)))
    at = at.withColumn("si", moved("x", "si", top.x0, top.w, "row")).withColumn("sj", moved("y", "sj", top.y0, top.h, "col"))
    return at.join(states.select("cell", "si", "sj", "state"), ["cell", "si", "sj"]).select(*pts.columns, "state")


def subcell_neighbours(states: DataFrame) -> DataFrame:
    """(state, other): states that share an edge; across top cells the whole facing side of the neighbour."""
    mine = states.select("state", "cell", "row", "col", "m", "si", "sj")
    theirs = states.select(F.col("state").alias("other"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("m").alias("om"), F.col("si").alias("oi"), F.col("sj").alias("oj"))
    step = F.explode(F.expr("array(struct(0 as dr, 1 as dc), struct(0 as dr, -1 as dc), struct(1 as dr, 0 as dc), struct(-1 as dr, 0 as dc))"))
    ways = mine.withColumn("_s", step).select("*", "_s.dr", "_s.dc").drop("_s")
    edge = F.expr("case when dr = 1 then si = m - 1 when dr = -1 then si = 0 when dc = 1 then sj = m - 1 else sj = 0 end")
    inside = ways.where(~edge).join(theirs, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")) & (F.col("si") + F.col("dr") == F.col("oi")) & (F.col("sj") + F.col("dc") == F.col("oj")))
    facing = F.expr("case when dr = 1 then oi = 0 when dr = -1 then oi = om - 1 when dc = 1 then oj = 0 else oj = om - 1 end")
    across = ways.where(edge).join(theirs, (F.col("row") + F.col("dr") == F.col("r")) & (F.col("col") + F.col("dc") == F.col("c"))).where(facing)
    return inside.union(across).select("state", "other").distinct()


def _checked(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a model of checked size, in their order; numbers need 8 bytes each."""
    most = MOST_BYTES // (8 * len(columns))
    table = df.select(*columns).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"a model of over {most} entries is too large to send to every task")
    return [x.to_numpy() for x in table.sort_by([(c, "ascending") for c in columns])]


def state_paths(states: DataFrame, near: DataFrame, pairs: DataFrame | None = None, arrays: bool = False) -> DataFrame:
    """(src, dst, steps, coarse): states on the shortest path by distance of centres, and top cells that it passes.

    Of paths of one length, the one with the fewest states, then the smallest states from its end on. pairs: the (src, dst)
    that are wanted, all by default, or (src, wanted), a row a source, as allowed_ends gives them. arrays: a row a source, (src,
    dst, steps), whose dst and steps are arrays. States that states_of made are searched from many sources at once (Lattice); in other
    graphs a search goes state by state and ends when it has its source's pairs. The graph of the states is sent to the tasks, of
    checked size; sources are dealt over them.
    """
    ready(states.sparkSession)
    state, cell, x0, x1, y0, y1 = _checked(states, "state", "cell", "x0", "x1", "y0", "y1")
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    a, b = _checked(near, "state", "other")
    ia, ib = np.searchsorted(state, a), np.searchsorted(state, b)
    far = np.round(np.hypot(x[ia] - x[ib], y[ia] - y[ib]), 9)
    sent = states.sparkSession.sparkContext.broadcast((state, cell, np.searchsorted(ia, np.arange(len(state) + 1)), ib, far, Lattice.of(cell, ia, ib, far)))

    every = pairs is None

    def search(src: int, wanted: set | None) -> list[tuple]:
        state, cell, offsets, to, far, _ = sent.value
        start = int(np.searchsorted(state, src))
        out, done, heap = [], set(), [(0.0, 1, start, start, 1)]
        while heap and (wanted is None or wanted):
            d, steps, at, _, coarse = heapq.heappop(heap)
            if at in done:
                continue
            done.add(at)
            if wanted is None or int(state[at]) in wanted:
                out.append((src, int(state[at]), steps, coarse))
                if wanted is not None:
                    wanted.discard(int(state[at]))
            for k in range(offsets[at], offsets[at + 1]):
                if (there := int(to[k])) not in done:
                    heapq.heappush(heap, (round(d + float(far[k]), 9), steps + 1, there, at, coarse + int(cell[there] != cell[at])))
        return out

    def found(src: int, dst: np.ndarray, steps: np.ndarray, coarse: np.ndarray) -> pa.RecordBatch:
        if arrays:
            whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array([src], pa.int32()), whole(dst), whole(steps)], names=["src", "dst", "steps"])
        columns = {"src": np.full(len(dst), src), "dst": dst, "steps": steps, "coarse": coarse}
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns.values()], names=list(columns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, cell, *_, lattice = sent.value
        for batch in batches:
            asked = batch.column("src").to_numpy()
            wanted = None if every else batch.column("wanted")
            if lattice is None:
                for k, src in enumerate(asked.tolist()):
                    rows = search(src, None if every else set(wanted[k].as_py()))
                    yield found(src, *np.array([r[1:] for r in rows], np.int64).reshape(-1, 3).T)
                continue
            at = np.searchsorted(state, asked)
            order = np.argsort(cell[at], kind="stable")
            step = max(1, (1 << 20) // len(state))
            for own in np.split(order, np.flatnonzero(np.diff(cell[at[order]])) + 1):
                for some in (own[k : k + step] for k in range(0, len(own), step)):
                    steps, coarse = lattice.search(at[some])
                    for row, k in enumerate(some.tolist()):
                        to = np.arange(len(state)) if every else np.searchsorted(state, wanted[k].values.to_numpy())
                        to = to[steps[row, to] > 0]
                        yield found(asked[k], state[to], steps[row, to], coarse[row, to])

    out = "src int, dst array<int>, steps array<int>" if arrays else "src int, dst int, steps int, coarse int"
    if not every and "wanted" in pairs.columns:
        return pairs.select("src", "wanted").mapInArrow(walk, out)  # dealt already
    sources = states.select(F.col("state").alias("src")) if every else pairs.groupBy("src").agg(F.collect_set("dst").alias("wanted"))
    # A search is much work for few bytes, so sources go to a stated number of tasks.
    return sources.repartition(tasks(states.sparkSession), "src").mapInArrow(walk, out)


def allowed_ends(moves: DataFrame, near: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """(src, wanted): for each of the starts (src) those of the stops (dst) that two_step_mask of the moves (src, dst) allows it.

    A row a start instead of a row a pair: a move's row of ends goes to the starts within two steps of it, and grows there by
    the steps that are left. The graph of the states is sent to the tasks, of checked size.
    """
    spark = near.sparkSession
    ready(spark)
    a, b = _checked(near, "state", "other")
    stop = _checked(stops.select("dst"), "dst")[0]
    n = int(max(*(int(v.max(initial=-1)) for v in (a, b, stop)), moves.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0)) + 1
    sent = spark.sparkContext.broadcast((np.searchsorted(a, np.arange(n + 1)), b, stop))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, to, stop = sent.value
        last = np.zeros(n, bool)
        last[stop] = True
        for batch in batches:
            for src, rows in zip(batch.column("src").to_pylist(), batch.column("rows")):
                left = np.full(n, 3, np.int8)
                for far, ends in zip(rows.values.field("far").to_numpy(), rows.values.field("ends")):
                    ends = ends.values.to_numpy()
                    left[ends] = np.minimum(left[ends], far)
                for far in (0, 1):
                    at = np.flatnonzero(left == far)
                    size = offsets[at + 1] - offsets[at]
                    beside = to[np.arange(size.sum()) + np.repeat(offsets[at] - np.cumsum(size) + size, size)]
                    left[beside[left[beside] > far + 1]] = far + 1
                ends = np.flatnonzero((left < 3) & last).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([src], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))], names=["src", "wanted"])

    rows = cut(moves.groupBy(F.col("src").alias("at")).agg(F.collect_set("dst").alias("ends")))
    one = near.select(F.col("state").alias("src"), F.col("other").alias("at"))
    two = one.join(one.select(F.col("src").alias("at"), F.col("at").alias("_t")), "at").select("src", F.col("_t").alias("at"))
    alone = rows.select(F.col("at").alias("src"), "at")
    ball = alone.withColumn("far", F.lit(0)).union(one.withColumn("far", F.lit(1))).union(two.withColumn("far", F.lit(2)))
    ball = cut(ball.join(starts.select("src"), "src", "left_semi").groupBy("src", "at").agg(F.min("far").alias("far")))
    dealt = ball.join(rows.hint("merge"), "at").repartition(max(tasks(spark), n // 512), "src")
    return dealt.groupBy("src").agg(F.collect_list(F.struct("far", "ends")).alias("rows")).mapInArrow(grow, "src int, wanted array<int>")


def calibrate_trips(starts: DataFrame, stops: DataFrame, paths: DataFrame, mask: DataFrame, total: float, rounds: int = 25) -> DataFrame:
    """(src, dst, w): trips whose lengths-weighted sums fit the starts (src, w) and the stops (dst, w), over allowed pairs.

    A trip of a pair weighs 1 / steps. The sums are fitted in turn, which lessens both errors in every round until they
    vanish, where that is possible; then trips are scaled to `total`, pairs under 0.8 go, and the rest is scaled again.
    """
    allowed = paths.join(mask.select("src", "dst"), ["src", "dst"]).join(F.broadcast(starts.where("w > 0")), "src", "left_semi").join(F.broadcast(stops.where("w > 0")), "dst", "left_semi")
    rows = allowed.groupBy("src").agg(F.collect_list(F.struct("dst", "steps")).alias("_p"))
    return calibrate_rows(starts, stops, rows.select("src", F.col("_p.dst").cast("array<int>").alias("dst"), F.col("_p.steps").cast("array<int>").alias("steps")), total, rounds)


def calibrate_rows(starts: DataFrame, stops: DataFrame, paths: DataFrame, total: float, rounds: int = 25) -> DataFrame:
    """As calibrate_trips, with the allowed paths as (src, dst, steps), a row a start with arrays of stops and of steps.

    A pair's weight is a factor of its start times one of its stop: a start's follows from its row and the stops' factors, so a
    round reads the rows once and sends a number a stop, of checked size.
    """
    spark = starts.sparkSession
    ready(spark)
    # Only starts and stops with mass have trips.
    base = cut(paths.where("size(dst) > 0").join(F.broadcast(starts.where("w > 0").select("src", F.col("w").cast("double").alias("a"))), "src").select("src", "a", "dst", "steps"))
    dst, b = _checked(stops.where("w > 0").select("dst", F.col("w").cast("double").alias("b")), "dst", "b")
    n = int(dst.max(initial=-1)) + 1
    mass, y = np.zeros(n), np.zeros(n)
    mass[dst], y[dst] = b, 1.0

    def factors(batch: pa.RecordBatch, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair of the rows: its place in the rows and its stop; and the starts' factors."""
        own = batch.column("dst")
        size, to = own.value_lengths().to_numpy(), own.flatten().to_numpy()
        first = np.cumsum(size) - size
        return size, to, np.ones(len(size)) if y is None else batch.column("a").to_numpy() / np.add.reduceat(y[to], first)

    def summed(sent):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n)
            for batch in batches:
                size, to, x = factors(batch, sent.value)
                out += np.bincount(to, np.repeat(x, size), n)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], names=["dst", "s"])

        return over

    before = None
    for _ in range(rounds):
        before, sent = y, spark.sparkContext.broadcast(y)
        to, s = _checked(base.select("a", "dst").mapInArrow(summed(sent), "dst int, s double").groupBy("dst").agg(F.sum("s").alias("s")), "dst", "s")
        y = y.copy()
        y[to] = mass[to] / s
        sent.unpersist()
    sent = spark.sparkContext.broadcast((before, y))

    def weights(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, y = sent.value
        size, to, x = factors(batch, before)
        return np.repeat(batch.column("src").to_numpy(), size), to, np.repeat(x, size) * y[to] * np.maximum(batch.column("steps").flatten().to_numpy(), 1)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(weights(batch)[2].sum())])], names=["w"])

    every = base.mapInArrow(whole, "w double").agg(F.sum("w")).first()[0]

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, to, w = weights(batch)
            w = w / every * total
            some = w >= 0.8
            yield pa.RecordBatch.from_arrays([pa.array(src[some].astype(np.int32)), pa.array(to[some].astype(np.int32)), pa.array(w[some])], names=["src", "dst", "w"])

    trips = cut(base.mapInArrow(large, "src int, dst int, w double") if every else spark.createDataFrame([], "src int, dst int, w double"))
    return trips.crossJoin(F.broadcast(trips.agg(F.sum("w").alias("_all")))).withColumn("w", F.try_divide("w", "_all") * total).drop("_all")  # one row


class _Rows:
    """Numbers by key, row by row: for each key its columns and their weights, only those that are there."""

    def __init__(self, key: np.ndarray, columns: np.ndarray, w: np.ndarray):
        order = np.lexsort((columns, key))
        self.keys, begin = np.unique(key[order], return_index=True)
        self.offsets, self.columns, self.w = np.append(begin, len(key)), columns[order].astype(np.int64), w[order].astype(float)

    def row(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        k = int(np.searchsorted(self.keys, key))
        if k == len(self.keys) or self.keys[k] != key:
            return self.columns[:0], self.w[:0]
        return self.columns[self.offsets[k] : self.offsets[k + 1]], self.w[self.offsets[k] : self.offsets[k + 1]]


class _Walker:
    """Draws one trip over the states 0, 1, ..., or None where one of the rules rejects it.

    first: rows of the next states and the end (number n) by state, and of the first states by n. second: the same by cur *
    (n + 1) + prev, for states that have any. trips: rows of ends and weights by start; steps: of the paths' states.
    """

    def __init__(self, first, second, sensitive, trips, steps, limit, cell, place, m, near, size):
        self.first, self.second, self.sensitive, self.trips, self.steps, self.limit = first, second, sensitive, trips, steps, limit
        self.cell, self.place, self.m, self.near, self.size = cell, place, m, near, size
        self.end = len(cell)
        inner = (self.first.columns < self.end) & np.repeat(self.first.keys < self.end, np.diff(self.first.offsets))
        self.mass_in = np.bincount(self.first.columns[inner], self.first.w[inner], self.end)

    def trip(self, rng: np.random.Generator) -> list[int] | None:
        end = self.end
        to, w = self.first.row(end)
        to, w = to[to < end], w[to < end]
        now, before = int(rng.choice(to, p=w / w.sum())), end
        ends, w = self.trips.row(now)
        expected = int(self.steps.row(now)[1][rng.choice(len(ends), p=w / w.sum())]) if len(ends) else 1
        limit = self.limit[now]
        limit = limit if limit > 0 else int(0.8 * self.size)
        out, tops, here, tests, pending = [], 0, 0, 0, False
        while now != end:
            moved = not out or self.cell[out[-1]] != self.cell[now]
            out.append(now)
            tops, here = tops + moved, 1 if moved else here + 1
            pending = pending or (len(out) > 1 and moved) or len(out) == 2
            m = self.m[self.cell[now]]
            if pending and m > 1 and here / m > 0.4:
                pending, tests = False, tests + 1
                wide = len({self.cell[x] for x in out}) / tops > 0.6
                if tops > limit * (1 if wide else 2) and rng.random() >= min(tests / self.size, 0.95):
                    return None
            to, w = self._weights(now, before, len(out), tops, expected)
            before = now
            if w.sum() > 0:
                now = int(rng.choice(to, p=w / w.sum()))
            else:
                options = self.near.row(now)[0]
                mass = self.mass_in[options]
                now = int(rng.choice(options, p=mass / mass.sum() if mass.sum() > 0 else None))
            if len(out) > (200 if tops <= 2 else 100) or (len(out) > 8 and self._lingers(out)):
                return None
            if now != end and sum(abs(a - b) for a, b in zip(self.place[self.cell[now]], self.place[self.cell[before]])) > 1:
                return None
        return out

    def _weights(self, now: int, before: int, steps: int, tops: int, expected: int) -> tuple[np.ndarray, np.ndarray]:
        to, w = self.second.row(now * (self.end + 1) + before) if now in self.sensitive else (None, np.zeros(0))
        if w.sum() == 0:
            to, w = self.first.row(now)
        w = w.copy()
        last = to == self.end
        if tops == 1:
            w[last] *= 0.5 * (0.2 if steps < 0.5 * expected else 1)
        w[last] *= 0.8
        return to, w

    def _lingers(self, out: list[int]) -> bool:
        counts = np.sort(np.unique(out, return_counts=True)[1])[::-1]
        few = int(len(out) * 0.2)
        return len(counts) <= few or counts[:few].sum() > 0.6 * len(out)


def synth_adaptive(states: DataFrame, near: DataFrame, first: DataFrame, second: DataFrame, trips: DataFrame, paths: DataFrame, limits: DataFrame, top_side: int, number: int, seed: int = 0, tries: int = 10_000) -> DataFrame:
    """dataset, traj_id, seq, cell: walks of first order, or of second order at sensitive states, from start to end.

    first: (src, dst, w) with start -1 and end -2. second: (prev, cur, next, w) likewise. trips: (src, dst, w) calibrated.
    paths: state_paths. limits: (src, length). top_side: top cells a side. The end is damped on the first top cell and
    before half the expected path; walks that are too long, linger or leap over top cells are drawn again, each with its
    own random numbers; an error after `tries` rejections. The model is sent to the tasks, of checked size.
    """
    spark = states.sparkSession
    ready(spark)
    state, cell, m, row, col = _checked(states, "state", "cell", "m", "row", "col")
    n = len(state)
    if not np.array_equal(state, np.arange(n)):
        raise ValueError("states are numbered 0, 1, ...")
    place = dict(zip(cell.tolist(), zip(row.tolist(), col.tolist())))
    src, dst, w = _checked(first.where("dst != -1 and src != -2"), "src", "dst", "w")
    one = _Rows(np.where(src < 0, n, src), np.where(dst < 0, n, dst), w)
    cur, prev, to, w = _checked(second, "cur", "prev", "next", "w")
    two = _Rows(cur.astype(np.int64) * (n + 1) + np.where(prev < 0, n, prev), np.where(to < 0, n, to), w)
    # Paths only of pairs that trips go between.
    wanted = trips.where("w > 0").select("src", "dst", "w").join(paths.select("src", "dst", "steps"), ["src", "dst"], "left").fillna(1, ["steps"])
    src, dst, w, steps = _checked(wanted, "src", "dst", "w", "steps")
    a, b = _checked(near, "state", "other")
    limit = np.full(n, -1.0)
    at, length = _checked(limits, "src", "length")
    limit[at] = length
    sent = spark.sparkContext.broadcast((one, two, set(np.unique(cur).tolist()), _Rows(src, dst, w), _Rows(src, dst, steps), limit, cell, place, dict(zip(cell.tolist(), m.tolist())), _Rows(a, b, np.ones(len(a))), top_side))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = _Walker(*sent.value)
        for batch in batches:
            ids, seqs, cells = [], [], []
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                found = next((t for t in (walker.trip(rng) for _ in range(tries)) if t), None)
                if found is None:
                    raise ValueError(f"walker {k}: {tries} walks were rejected")
                ids += [int(k)] * len(found)
                seqs += range(len(found))
                cells += found
            yield pd.DataFrame({"dataset": "synthetic", "traj_id": pd.Series(ids, dtype="int64"), "seq": pd.Series(seqs, dtype="int64"), "cell": pd.Series(cells, dtype="int32")})

    return spark.range(number).mapInPandas(walk, "dataset string, traj_id long, seq long, cell int")
