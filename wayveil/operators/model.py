"""Noise and mobility models: start-end pairs, transitions, lengths. Models are long tables (src, dst, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayveil.functions.scalar import unit_hash
from wayveil.functions.tables import cut, with_share
from wayveil.operators.grid import TRIP, grid_steps, neighbours


def laplace(key: list[Column], eps: float, sensitivity: float = 1.0, seed: int = 0) -> Column:
    """Laplace noise from a hash of the key: the same for every partitioning and rerun."""
    u = unit_hash(*key, seed=seed) - 0.5
    return -sensitivity / eps * F.signum(u) * F.log1p(-2 * F.abs(u))


def clip_round(w: Column, whole: bool = False) -> Column:
    out = F.greatest(w, F.lit(0.0))
    return F.round(out) if whole else out


def row_normalise(df: DataFrame, row: list[str], w: str = "w") -> DataFrame:
    """Shares of each row's sum; a row without mass stays 0."""
    return df.withColumn(w, F.coalesce(F.col(w) / F.nullif(F.sum(w).over(W.partitionBy(*row)), F.lit(0.0)), F.lit(0.0)))


def queue_minus(df: DataFrame, row: list[str], w: str = "w", tie: str = "dst") -> DataFrame:
    """Takes each row's negative mass from its smallest positive values; all 0 if the negatives win."""
    negative = -F.sum(F.least(F.col(w), F.lit(0.0))).over(W.partitionBy(*row))
    order = W.partitionBy(*row).orderBy(F.greatest(F.col(w), F.lit(0.0)), tie).rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum(F.greatest(F.col(w), F.lit(0.0))).over(order)
    return df.withColumn(w, F.greatest(F.lit(0.0), F.least(upto - negative, F.greatest(F.col(w), F.lit(0.0)))))


def exp_mechanism(df: DataFrame, group: list[str], candidate: str, score: str, eps: float, seed: int = 0) -> DataFrame:
    """One candidate a group, with probability in proportion to exp(eps * score / 2): the largest score with Gumbel noise."""
    gumbel = -F.log(-F.log(unit_hash(*[F.col(c) for c in group], F.col(candidate), seed=seed)))
    return df.groupBy(*group).agg(F.max_by(candidate, eps * F.col(score) / 2 + gumbel).alias(candidate))


def ends(cells: DataFrame) -> DataFrame:
    """First and last cell and length of each trip."""
    return cells.groupBy(*TRIP).agg(F.min_by("cell", "seq").alias("src"), F.max_by("cell", "seq").alias("dst"), F.count("*").alias("length"))


def dp_median_length(cells: DataFrame, eps: float | None, seed: int = 0) -> DataFrame:
    """(src, dst, length): a median length by pair by N4's mechanism over the pair's sorted lengths, 2 at least.

    A length's score is -|rank - n / 2| with ranks from 0; trips of one cell, or above 1.25 of the longest, are left out.
    eps None: the best score, ties to the shorter.
    """
    trips = ends(cells)
    longest = trips.agg((1.25 * F.max("length")).alias("most"))
    trips = trips.crossJoin(F.broadcast(longest)).where((F.col("length") >= 2) & (F.col("length") <= F.col("most")))  # one row
    own = W.partitionBy("src", "dst")
    ranked = trips.withColumn("rank", F.row_number().over(own.orderBy("length", *TRIP)) - 1).withColumn("n", F.count("*").over(own))
    scored = ranked.withColumn("score", -F.abs(F.col("rank") - F.col("n") / 2)).withColumn("pick", F.struct("rank", "length"))
    if eps is None:
        best = scored.groupBy("src", "dst").agg(F.max_by("pick", F.struct("score", -F.col("rank"))).alias("pick"))
    else:
        best = exp_mechanism(scored, ["src", "dst"], "pick", "score", eps, seed)
    return best.select("src", "dst", F.greatest(F.col("pick.length"), F.lit(2)).alias("length"))


def od_counts(cells: DataFrame) -> DataFrame:
    """(src, dst, n, p): trips by first and last cell."""
    n = ends(cells).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return with_share(n, "n", "p")


def moves(cells: DataFrame) -> DataFrame:
    own = W.partitionBy(*TRIP).orderBy("seq")
    return cells.select(*TRIP, F.col("cell").alias("src"), F.lead("cell").over(own).alias("dst"), F.count("*").over(W.partitionBy(*TRIP)).alias("length")).where("dst is not null")


def transitions(cells: DataFrame) -> DataFrame:
    """(src, dst, n, p): moves between cells."""
    n = moves(cells).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return with_share(n, "n", "p")


def transitions_weighted(cells: DataFrame, n: int, eps: float | None = None, adjacent_only: bool = True, seed: int = 0) -> DataFrame:
    """(src, dst, w) by source: each trip weighs 1 / moves; noise on the whole domain; rows sum to 1."""
    w = moves(cells).groupBy("src", "dst").agg(F.sum(1 / (F.col("length") - 1)).alias("w"))
    spark = cells.sparkSession
    if adjacent_only:
        domain = neighbours(spark, n).select(F.col("cell").alias("src"), F.col("other").alias("dst"))
    else:
        domain = spark.range(n**4).select(F.floor(F.col("id") / n**2).cast("int").alias("src"), (F.col("id") % n**2).cast("int").alias("dst"))
    full = domain.join(w, ["src", "dst"], "left").fillna(0.0, ["w"])
    if eps is not None:
        full = full.withColumn("w", clip_round(F.col("w") + laplace([F.col("src"), F.col("dst")], eps, seed=seed)))
    return row_normalise(full, ["src"])


def transitions_start_end(states: DataFrame, eps: float | None = None, seed: int = 0) -> DataFrame:
    """(src, dst, w) with a start state -1 and an end state -2; each trip of L states weighs 1 / (L + 1)."""
    own = W.partitionBy(*TRIP)
    base = states.withColumn("_n", F.count("*").over(own)).withColumn("_next", F.lead("cell").over(own.orderBy("seq"))).withColumn("_w", 1 / (F.col("_n") + 1))
    inner = base.select(F.col("cell").alias("src"), F.coalesce("_next", F.lit(-2)).alias("dst"), "_w")
    start = base.where("seq = 0").select(F.lit(-1).alias("src"), F.col("cell").alias("dst"), "_w")
    out = inner.union(start).groupBy("src", "dst").agg(F.sum("_w").alias("w"))
    if eps is not None:
        out = queue_minus(out.withColumn("w", F.col("w") + laplace([F.col("src"), F.col("dst")], eps, seed=seed)), ["src"])
    return out


def sensitive_states(matrix: DataFrame, eps: float, part: float = 0.6, share: float = 0.02, ratio: float = 5.0) -> DataFrame:
    """States whose next moves matter: ones with enough moves whose two best are close, and ones with over `share` of all
    outgoing mass (starts included), of the starts or of the ends.

    Enough: more than states * 1.414 / (eps * part). matrix: (src, dst, w) with a start state -1 and an end state -2.
    """
    states = matrix.select(F.col("src").alias("cell")).union(matrix.select("dst")).where("cell >= 0").distinct()
    inner = matrix.where("src >= 0 and dst >= 0")
    top = inner.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))).where("rank <= 2")
    close = top.groupBy("src").agg(F.max("w").alias("a"), F.min("w").alias("b"), F.count("*").alias("k")).where(F.expr(f"k = 2 and b > 0 and a / b < {ratio}")).select(F.col("src").alias("cell"), F.lit(True).alias("close"))
    moves_out = inner.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("moves"))
    out = matrix.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("out"))
    starts = matrix.where("src = -1 and dst >= 0").select(F.col("dst").alias("cell"), F.col("w").alias("starts"))
    stops = matrix.where("dst = -2 and src >= 0").select(F.col("src").alias("cell"), F.col("w").alias("stops"))
    whole = matrix.agg(F.sum("w").alias("all_out"), F.sum(F.when((F.col("src") == -1) & (F.col("dst") >= 0), F.col("w"))).alias("all_starts"), F.sum(F.when((F.col("dst") == -2) & (F.col("src") >= 0), F.col("w"))).alias("all_stops"))
    whole = whole.crossJoin(states.agg(F.count("*").alias("n")))  # one row
    every = states.join(moves_out, "cell", "left").join(out, "cell", "left").join(starts, "cell", "left").join(stops, "cell", "left").fillna(0.0).join(close, "cell", "left").crossJoin(F.broadcast(whole))
    enough = F.col("moves") > F.col("n") * 1.414 / (eps * part)
    large = lambda c: F.coalesce(F.col(c) > share * F.col(f"all_{c}"), F.lit(False))
    return every.where((enough & F.coalesce("close", F.lit(False))) | large("out") | large("starts") | large("stops")).select("cell")


def second_order(states: DataFrame, sensitive: DataFrame, first: DataFrame | None = None, eps: float | None = None, seed: int = 0) -> DataFrame:
    """(prev, cur, next, w): next moves of sensitive states by where the trip came from; each trip weighs 1 / length.

    prev -1: the trip starts there; next -2: it ends there. With eps: noise on the whole domain, N3 by (cur, prev), whole
    numbers by truncation. first: (src, dst, w) of the first order; ends are then scaled by 1.5 times the ratio of the
    first order's end mass to the second order's.
    """
    own = W.partitionBy(*TRIP).orderBy("seq")
    weight = 1 / F.count("*").over(W.partitionBy(*TRIP))
    base = states.select(F.coalesce(F.lag("cell").over(own), F.lit(-1)).alias("prev"), F.col("cell").alias("cur"), F.coalesce(F.lead("cell").over(own), F.lit(-2)).alias("next"), weight.alias("w"))
    out = base.join(sensitive.select(F.col("cell").alias("cur")), "cur", "left_semi").groupBy("prev", "cur", "next").agg(F.sum("w").alias("w"))
    if eps is not None:
        known = states.select("cell").distinct()
        side = lambda name, more: known.select(F.col("cell").alias(name)).union(states.sparkSession.range(1).select(F.lit(more).cast("int")))
        domain = sensitive.select(F.col("cell").alias("cur")).crossJoin(side("prev", -1)).crossJoin(side("next", -2))  # the model's own size
        out = domain.join(out, ["prev", "cur", "next"], "left").fillna(0.0, ["w"])
        out = out.withColumn("w", F.col("w") + laplace([F.col("cur"), F.col("prev"), F.col("next")], eps, seed=seed))
        out = queue_minus(out, ["cur", "prev"], tie="next").withColumn("w", F.floor("w").cast("double")).where("w > 0").select("prev", "cur", "next", "w")
    if first is not None:
        ends_of = first.where("dst = -2").select(F.col("src").alias("cur"), F.col("w").alias("_one"))
        two = F.sum(F.when(F.col("next") == -2, F.col("w")).otherwise(0.0)).over(W.partitionBy("cur"))
        scale = F.when((F.col("next") == -2) & (F.col("_two") > 0), 1.5 * F.coalesce("_one", F.lit(0.0)) / F.col("_two")).otherwise(1.0)
        out = out.withColumn("_two", two).join(ends_of, "cur", "left").select("prev", "cur", "next", (F.col("w") * scale).alias("w"))
        out = out.withColumn("w", F.floor("w").cast("double")) if eps is not None else out
    return out


def two_step_mask(transitions_: DataFrame, near: DataFrame) -> DataFrame:
    """(src, dst) of observed moves, grown twice by the spatial neighbours of either side. near: (cell, other)."""
    mask = transitions_.select("src", "dst").distinct()
    for _ in range(2):
        left = mask.join(near.select(F.col("cell").alias("src"), F.col("other").alias("_o")), "src").select(F.col("_o").alias("src"), "dst")
        right = mask.join(near.select(F.col("cell").alias("dst"), F.col("other").alias("_o")), "dst").select("src", F.col("_o").alias("dst"))
        mask = cut(mask.union(left).union(right).distinct())
    return mask


def length_thresholds(od: DataFrame, coarse: DataFrame, top_cells: int) -> DataFrame:
    """(src, length): expected coarse length of the trips from a state, -1 without trips.

    The coarse length of a pair is |rows| + |columns| + 1 between its top cells plus the square root of their number.
    od: (src, dst, w). coarse: (cell, row, col), a state's top cell.
    """
    side = lambda name, k: coarse.select(F.col("cell").alias(name), F.col("row").alias(f"r{k}"), F.col("col").alias(f"c{k}"))
    far = F.abs(F.col("r1") - F.col("r2")) + F.abs(F.col("c1") - F.col("c2")) + 1 + top_cells**0.5
    some = od.where("w > 0").join(side("src", 1), "src").join(side("dst", 2), "dst").groupBy("src").agg((F.sum(far * F.col("w")) / F.sum("w")).alias("length"))
    return coarse.select(F.col("cell").alias("src")).join(some, "src", "left").fillna(-1.0, ["length"])


def extra_lengths(cells: DataFrame, n: int) -> DataFrame:
    """(src, dst, extra, trips): how much longer trips are than the shortest route."""
    e = ends(cells).withColumn("extra", F.col("length") - grid_steps(F.col("src"), F.col("dst"), n))
    return e.groupBy("src", "dst", "extra").agg(F.count("*").alias("trips"))


def fit_extra_lengths(cells: DataFrame, n: int, eps: float | None = None, seed: int = 0) -> DataFrame:
    """(src, dst, mean, family, cap): the family nearest to the pair's extra lengths by earth mover's distance."""
    hist = extra_lengths(cells, n).where("extra >= 0")
    own = W.partitionBy("src", "dst")
    stats = hist.groupBy("src", "dst").agg(F.sum(F.col("extra") * F.col("trips")).alias("s"), F.sum("trips").alias("n"), F.max("extra").alias("most"))
    noise = laplace([F.col("src"), F.col("dst")], eps, seed=seed) / F.col("n") if eps else F.lit(0.0)
    stats = stats.select("src", "dst", "n", "most", F.greatest(F.col("s") / F.col("n") + noise, F.lit(0.0)).alias("mean"), F.round(1.3 * F.col("most")).cast("int").alias("cap"))
    every = stats.withColumn("extra", F.explode(F.sequence(F.lit(0), F.col("cap")))).join(hist.withColumn("extra", F.col("extra").cast("int")), ["src", "dst", "extra"], "left").fillna(0, ["trips"])
    k, m = F.col("extra"), F.col("mean")
    pmf = {
        "uniform": F.when(k <= F.round(2 * m), 1 / (F.round(2 * m) + 1)).otherwise(0.0),
        "geometric": F.pow(m / (m + 1), k) / (m + 1),
        "poisson": F.when(m > 0, F.exp(k * F.log(F.when(m > 0, m).otherwise(1.0)) - m - F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda t, i: t + F.log(i.cast("double"))))).otherwise(F.when(k == 0, 1.0).otherwise(0.0)),
    }
    running = own.orderBy("extra").rowsBetween(W.unboundedPreceding, 0)
    for name, p in pmf.items():
        every = every.withColumn(name, p)
    apart = every.select("src", "dst", "mean", "cap", *[F.abs(F.sum(F.col("trips") / F.col("n") - F.col(name)).over(running)).alias(name) for name in pmf])
    total = apart.groupBy("src", "dst", "mean", "cap").agg(*[F.sum(name).alias(name) for name in pmf])
    best = F.array_min(F.array(*[F.struct(F.round(F.col(name), 9), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(pmf)]))
    return total.select("src", "dst", "mean", best["name"].alias("family"), "cap")


def start_counts(states: DataFrame, domain: DataFrame, eps: float | None = None, seed: int = 0) -> DataFrame:
    """(cell, t, n) of first states over the full domain, noisy, none negative."""
    n = states.where("seq = 0").groupBy("cell", "t").agg(F.count("*").alias("n"))
    full = domain.join(n, ["cell", "t"], "left").fillna(0, ["n"]).withColumn("n", F.col("n").cast("double"))
    return full if eps is None else full.withColumn("n", clip_round(F.col("n") + laplace([F.col("cell"), F.col("t")], eps, seed=seed)))


def scale_counts(counts: DataFrame, total: int) -> DataFrame:
    """Adds whole: floor(T p) for the largest T whose floors sum to `total` at most.

    T lies between total and total + rows; each job tries 64 values between the bounds and keeps the gap that holds it.
    """
    shares = cut(with_share(counts, "n", "p"))
    low, high = total, total + shares.count() + 1
    while high - low > 1:
        step = max(1, (high - low + 63) // 64)
        tries = list(range(low + step, high, step))
        got = shares.agg(*[F.coalesce(F.sum(F.floor(t * F.col("p"))), F.lit(0)).alias(f"t{k}") for k, t in enumerate(tries)]).first() if tries else []
        fit = [t for t, n in zip(tries, got) if n <= total]
        low = max([low, *fit])
        high = min([high, *[t for t in tries if t not in fit]])
    return shares.withColumn("whole", F.floor(low * F.col("p"))).drop("p")


def space_time_transitions(states: DataFrame, n: int, times: int, eps: float | None = None, seed: int = 0) -> DataFrame:
    """(cell, t, cell2, t2, w) over the legal moves: stay for 1 or 2 steps, or go to a neighbour in 0 or 1."""
    spark = states.sparkSession
    own = W.partitionBy(*TRIP).orderBy("seq")
    seen = states.select("cell", "t", F.lead("cell").over(own).alias("cell2"), F.lead("t").over(own).alias("t2"), (1 / F.col("length")).alias("w")).where("cell2 is not null").groupBy("cell", "t", "cell2", "t2").agg(F.sum("w").alias("w"))
    offsets = F.explode(F.when(F.col("cell") == F.col("other"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))
    domain = neighbours(spark, n).withColumn("dt", offsets).crossJoin(spark.range(times).select(F.col("id").cast("int").alias("t")))  # 18 n^2 times rows: the model's domain
    domain = domain.select("cell", "t", F.col("other").alias("cell2"), (F.col("t") + F.col("dt")).alias("t2")).where(F.col("t2") < times)
    full = domain.join(seen, ["cell", "t", "cell2", "t2"], "left").fillna(0.0, ["w"])
    if eps is not None:
        full = full.withColumn("w", clip_round(F.col("w") + laplace([F.col(c) for c in ("cell", "t", "cell2", "t2")], eps, seed=seed)))
    return row_normalise(full, ["cell", "t"])


def markov_power(matrix: DataFrame, k: int) -> DataFrame:
    """(src, dst, w) of the k-th power, by doubling."""
    times = lambda a, b: a.join(b.select(F.col("src").alias("dst"), F.col("dst").alias("_d"), F.col("w").alias("_w")), "dst").groupBy("src", F.col("_d").alias("dst2")).agg(F.sum(F.col("w") * F.col("_w")).alias("w")).withColumnRenamed("dst2", "dst")
    base, out = matrix.where("w > 0").select("src", "dst", "w"), None
    while k:
        if k & 1:
            out = base if out is None else times(out, base)
        k >>= 1
        if k:
            base = times(base, base)
    return out


def prefix_next(cells: DataFrame, prefix: list[int]) -> DataFrame:
    """(next, trips) after a prefix of states; next null: the trips that end there."""
    trips = cells.groupBy(*TRIP).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cell"))), lambda p: p["cell"]).alias("cells"))
    match = trips.where(F.slice("cells", 1, len(prefix)) == F.array(*[F.lit(c).cast("int") for c in prefix]))
    return match.groupBy(F.try_element_at("cells", F.lit(len(prefix) + 1)).alias("next")).agg(F.count("*").alias("trips"))
