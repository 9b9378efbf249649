"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a weight schedule, knots of (t, weight) over training time 0..1, linear between them. Its integral is the
source's weight: sources share the words of all documents by weight, no target goes above `cap` times the source's size,
and the excess is shared again by weight until none is above. The schedule's running integral, scaled to the target, is
the source's cumulative demand; inverting it at a document's place in the source's stream of words gives the document's
training position, and documents are range-sorted by position.

A source's stream is its documents in hash order, once through for each whole multiple of its size, then as far as the
target asks: the last document enters if that brings the taken words nearer. No document is taken more than `cap` times.
Places in a stream come from running sums in two steps (hash bins of a source, then inside a bin), so a source that holds
a third of all rows is many bins, not one task.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; rows with a null id are mixed like any
other. Repeated rows are documents of their own. A source whose schedule is zero throughout has the target 0. An empty
table gives an empty mix. Other columns are ignored by the plan; mixed_documents returns every row with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Schedules by weight, as multiples of it at t = 0 and t = 1; each has the integral 1.
SHAPES = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
_SOURCE = ("no_source", "source_name")


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, its source's key, size in words and a hash that orders the source's stream, and the carried columns; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", text).alias("place"),
        *carry,
    )


def default_schedule(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights repeat over the sources in code point order, null last; each weight has its shape over time."""
    rank = F.row_number().over(W.orderBy(*_SOURCE)) - 1  # a row for each source
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    shape = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in (SHAPES.get(w, (1.0, 1.0)) for w in weights)])
    ends = F.element_at(shape, (rank % len(weights) + 1).cast("int"))
    knots = F.array(*[F.struct(F.lit(t).alias("t"), (weight * ends[i]).alias("w")) for i, t in enumerate((0.0, 1.0))])
    return sources.select(*_SOURCE, "source_size", knots.alias("knots"))


def targets(scheduled: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds weight (the schedule's integral) and target: shares of all words by weight, none above cap times its source."""
    area = lambda i: (F.col("knots")[i + 1]["t"] - F.col("knots")[i]["t"]) * (F.col("knots")[i + 1]["w"] + F.col("knots")[i]["w"]) / 2
    weight = F.aggregate(F.sequence(F.lit(0), F.size("knots") - 2), F.lit(0.0), lambda t, i: t + area(i))
    base = scheduled.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    every, before = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.try_divide("most", "weight").asc_nulls_last(), *_SOURCE).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0.0)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), none)
    over = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none)
    stopped = base.withColumn("stopped", (F.col("weight") > 0) & (left * F.col("weight") >= F.col("most") * over))
    free = lambda x, otherwise: F.sum(F.when(F.col("stopped"), otherwise).otherwise(F.col(x))).over(every)
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("stopped"), F.col("most")).otherwise(none)).over(every)
    share = F.least(F.col("most"), rest * F.col("weight") / F.nullif(free("weight", none), none))
    return stopped.select(*_SOURCE, "source_size", "knots", "weight", F.when(F.col("stopped"), F.col("most")).when(F.col("weight") > 0, share).otherwise(none).alias("target"))


def position(part: Column, knots: Column, weight: Column) -> Column:
    """The time at which the running integral of the schedule reaches `part` (0..1) of its whole."""
    need = part * weight
    w, t = (lambda i: knots[i]["w"]), (lambda i: knots[i]["t"])
    width = lambda i: t(i + 1) - t(i)
    area = lambda i: width(i) * (w(i) + w(i + 1)) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"), F.lit(0).alias("i"))
    last = F.size(knots) - 2
    pass_by = lambda s, i: F.when((s["sum"] + area(i) < need) & (i < last), F.struct((s["sum"] + area(i)).alias("sum"), (s["sum"] + area(i)).alias("low"), (i + 1).alias("i"))).otherwise(F.struct(F.lit(float("inf")).alias("sum"), s["low"].alias("low"), s["i"].alias("i")))
    found = F.aggregate(F.sequence(F.lit(0), last), start, pass_by)
    i, y = found["i"], F.greatest(need - found["low"], F.lit(0.0))
    slope = F.coalesce(F.try_divide(w(i + 1) - w(i), width(i)), F.lit(0.0))
    root = F.sqrt(F.greatest(w(i) * w(i) + 2 * slope * y, F.lit(0.0)))
    return F.least(t(i) + F.coalesce(2 * y / F.nullif(w(i) + root, F.lit(0.0)), F.lit(0.0)), t(i + 1))


def mix(docs: DataFrame, schedule=default_schedule, cap: float = 3.0, bin_rows: int = 1 << 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, place, size, source_size, target, taken, repeats, positions, *carry.

    schedule: from (no_source, source_name, source_size) to the same with `knots`, an array of (t, w) from t = 0 to 1.
    positions: one for each time the document is taken, in 0..1. taken: size times their number.
    bin_rows: rows of a hash bin of a source, about, if that source holds all rows; there are 1,024 bins at least.
    """
    known = cut(sized(docs, carry))
    bits = min(30, max(10, (known.count() // bin_rows).bit_length()))
    known = known.withColumn("bin", F.shiftrightunsigned("place", 64 - bits))
    bins = cut(known.groupBy(*_SOURCE, "bin").agg(F.sum("size").alias("n")))
    plan = targets(schedule(bins.groupBy(*_SOURCE).agg(F.sum("n").alias("source_size"))), cap)
    offsets = bins.select(*_SOURCE, "bin", F.coalesce(F.sum("n").over(W.partitionBy(*_SOURCE).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*_SOURCE, "bin").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = placed.join(offsets.join(cut(plan), [*_SOURCE]), [*_SOURCE, "bin"]).withColumn("before", F.col("offset") + F.col("inside"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    enters = (F.col("size") > 0) & (rest > 0) & (F.col("before") + F.col("size") / 2 <= rest) & (F.col("whole") < cap)
    counted = rows.withColumn("whole", whole.cast("int")).withColumn("repeats", F.col("whole") + F.when(enters, 1).otherwise(0))
    part = lambda k: (k * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    at = F.transform(F.sequence(F.lit(0), F.col("repeats") - 1), lambda k: position(F.least(part(k), F.lit(1.0)), F.col("knots"), F.col("weight")))
    return counted.select("doc_id", "place", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", F.when(F.col("repeats") > 0, at).otherwise(F.array().cast("array<double>")).alias("positions"), *carry)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it, range-sorted by training position."""
    plain = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    keys = ["key_a", "key_b"]
    row = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*plain).alias("key_a"), F.xxhash64(F.lit(1), *plain).alias("key_b"))
    plan = cut(mix(row, carry=tuple(keys), **parameters).select(*keys, "positions"))
    # Rows that repeat each other in every column share a key: one of them stands for all, at the positions of all.
    repeated = cut(plan.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    once = row.select(*keys, "row").join(repeated, keys, "left_anti")
    several = row.select(*keys, "row").join(repeated, keys, "left_semi").dropDuplicates(keys)
    joined = once.union(several).join(plan.select(*keys, F.explode("positions").alias("position")), keys)
    return joined.orderBy("position", "row.doc_id", *keys).select("row.*")
