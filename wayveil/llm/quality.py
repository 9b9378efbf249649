"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed in one pass. Shallow trees of a random forest, fitted on labelled rows, give
their paths as conjunctive rules; a logistic model with a lasso penalty weighs the rules; the rules that keep a weight
are compiled into one Spark column expression over the statistics.

The model is fitted on at most `max_rows` labelled rows, those with the smallest hash of their id: a documented bound.
Rows whose crc32(doc_id as text) mod 3 is 1 are held out of fitting. Labels, lang, source and doc_id are no inputs.

Nulls: a null text is an empty one; all its statistics are 0 and it gets a score. A null id is never held out. Labels
other than 0 and 1, null among them, are left out; repeated rows count as often as they stand. Without labelled rows the score is 0.5;
with one class only it is that class's share. Other columns pass through untouched; the statistics' own column takes a
name that docs does not have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, bounded_batches, cut, slices

STATISTICS = (
    "words", "word_bytes", "upper", "digits", "symbols", "bangs", "pipes", "wide", "lines", "stops",
    "odd_words", "shouted", "repeats", "recent", "distinct", "worst_odd", "worst_shouted", "worst_repeats", "worst_recent",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*@^~<>=+_\\/{}[]|")] = True
_STRETCH = 32


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    w = Words(texts)
    raw, at, first = w.raw, w.offsets, w.first
    n_bytes, n_words = np.maximum(np.diff(at), 1), np.diff(first)
    per = np.maximum(n_words, 1)
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    share = lambda flags: _sums(flags, at) / n_bytes
    letters = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.stack([w.starts, w.ends])], axis=0)[0]
    ups, lows = letters(upper), letters(lower)
    odd = _SYMBOLS[raw[w.ends - 1]] if len(w.ends) else np.zeros(0, bool)
    shouted = (ups >= 2) & (lows == 0)
    h = w.hash
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    same = lambda k: np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (text_of[k:] == text_of[:-k])])
    repeats = same(1)
    recent = repeats | same(2) | same(3) | same(4)
    distinct = np.zeros(len(n_words))
    for i in np.flatnonzero(n_words):
        distinct[i] = len(np.unique(h[first[i] : first[i + 1]])) / n_words[i]

    def worst(flags):
        """The largest share in any stretch of words."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        begin = np.arange(len(h))
        end = np.minimum(begin + _STRETCH, first[1:][text_of])
        begin = np.maximum(end - _STRETCH, first[:-1][text_of])
        out = np.zeros(len(n_words))
        some = np.flatnonzero(n_words)
        if len(some):
            out[some] = np.maximum.reduceat((total[end] - total[begin]) / np.maximum(end - begin, 1), first[:-1][some])
        return out

    per_word = lambda flags: _sums(flags, first) / per
    stops = np.isin(raw, np.frombuffer(b".?", np.uint8))
    columns = [
        np.log1p(n_words), _sums(w.ends - w.starts, first) / per, share(upper), share((raw >= 48) & (raw <= 57)), share(_SYMBOLS[raw]), share(raw == 33), share(raw == 124), share(raw >= 128), share(raw == 10), share(stops),
        per_word(odd), per_word(shouted), per_word(repeats), per_word(recent), distinct, worst(odd), worst(shouted), worst(repeats), worst(recent),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def with_statistics(docs: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in keep) and an array of STATISTICS under `name`."""
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(f"{name}_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"{name}_text"):
                stats = statistics(part.column(part.num_columns - 1))
                nested = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * len(STATISTICS), pa.int32()), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], nested], names=[*keep, name])

    return read.mapInArrow(work, T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Rules:
    """bias + sum of the weights of the rules that hold, as a logit. A rule: (statistic, is_above, threshold) terms."""

    bias: float = 0.0
    weighted: tuple = field(default_factory=tuple)

    def score(self, stats: Column) -> Column:
        """The compiled column expression, 0 to 1."""
        logit = F.lit(self.bias)
        for terms, weight in self.weighted:
            logit = logit + F.when(holds(terms, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def holds(terms: tuple, stats: Column) -> Column:
    out = F.lit(True)
    for k, above, limit in terms:
        out = out & ((stats[k] > limit) if above else (stats[k] <= limit))
    return out


def paths(description: str) -> list[tuple]:
    """All root-to-node paths of the trees in a forest's description, as sorted terms, each once."""
    found, stack = {}, []
    for line in description.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), (int(m[3]), m[4] == ">", float(m[5]))))
            found[tuple(sorted(x for _, x in stack))] = None
        elif "Tree" in line:
            stack = []
    return list(found)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, trees: int = 24, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> Rules:
    """Fit on at most max_rows labelled, not held-out rows."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    some = usable.select("doc_id", F.col("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(cut(some)), "doc_id")  # max_rows pairs of numbers
    table = cut(with_statistics(known, "stats", ["label"]))
    shares = table.groupBy("label").count().collect()
    n = sum(x["count"] for x in shares)
    if len(shares) < 2:
        share = sum(x["label"] * x["count"] for x in shares) / n if n else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Rules(float(np.log(share / (1 - share))))
    rows = table.select("label", "stats", array_to_vector("stats").alias("features")).coalesce(4).persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=max(2, n // 500), seed=seed).fit(rows)
    rules = paths(forest.toDebugString)
    flags = F.array(*[holds(r, F.col("stats")).cast("double") for r in rules])
    sparse = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=80, featuresCol="rules")
    fitted = sparse.fit(rows.select("label", array_to_vector(flags).alias("rules")))
    rows.unpersist()
    weights = fitted.coefficients.toArray()
    return Rules(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) for every row of docs."""
    rules = fit(docs, labels, **parameters)
    out = with_statistics(docs, "stats", ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.score(F.col("stats")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, **parameters) -> DataFrame:
    """The rows of docs that the classifier does not reject, in one pass without a shuffle."""
    rules = fit(docs, labels, **parameters)
    name = "stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, name).where(rules.score(F.col(name)) >= at_least).drop(name)
