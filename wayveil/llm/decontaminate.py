"""Benchmark decontamination with SimHash windows.

For a benchmark item of W words, a document's windows of W words get a SimHash of their five-word shingles. Fingerprints
are found by multi-index Hamming blocks: 64 bits in 8 blocks; if two fingerprints differ in at most 20 bits, some block
differs in at most 2, so looking up every block's values within 2 bits finds all fingerprints within the radius. The
candidates are then verified by the exact weighted similarity of their shingles, sum of least over sum of greatest
counts, at 0.75 or more.

Only windows that share a shingle with some item of their length are built: all others have similarity 0. The benchmark
is a stated query set; it is read in blocks of at most `block_items` items, each block is sent to the executors and goes
over all documents in one pass without a shuffle.

Items with fewer than five words have their whole sequence as their only shingle. Null or empty texts and items match
nothing. Null ids are carried as they are; repeated rows each get their own result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SHINGLE, Words, bounded_batches, slices

RADIUS = 20
BLOCKS = 8
_U = np.uint64
_VALUES = np.arange(256, dtype=np.uint8)
#: For each value of a block, the values within its share of the radius.
_NEAR = [_VALUES[np.bitwise_count(_VALUES ^ v) <= RADIUS // BLOCKS] for v in _VALUES]
_FILTER = 20
_CHUNK = 4096


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash bytes (rows x 8) of sums of +-1 by bit."""
    return np.packbits(sums > 0, axis=-1)


def _signs(grams: np.ndarray) -> np.ndarray:
    return np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of two multisets of shingles."""
    keys, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(which[: len(a)], minlength=len(keys)), np.bincount(which[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


def _table(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of a block, the items whose own value is near: items[at[v]:at[v + 1]]."""
    by_value = [np.flatnonzero(values == v) for v in range(256)]
    lists = [np.concatenate([by_value[x] for x in near]) for near in _NEAR]
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)


def _looked_up(tables: list[tuple], found: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of all pairs with a block in which they are near, each once."""
    pairs = []
    for (at, lists), values in zip(tables, found.T):
        low, n = at[values], at[values.astype(int) + 1] - at[values]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(low, n)
        pairs.append(np.repeat(np.arange(len(values)), n) * items + lists[place])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // items, pairs % items


class Index:
    """A block of benchmark items: by length in words, their shingles, fingerprints and Hamming tables."""

    def __init__(self, items: list[tuple], similarity: float):
        self.similarity = similarity
        words = Words(pa.array([t or "" for _, t in items], pa.string()))
        sizes = np.diff(words.first)
        self.ids = [i for i, _ in items]
        self.grams: dict[int, np.ndarray] = {}
        by_gram: dict[int, list] = {}
        self.classes: dict[int, tuple] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            g, own = min(SHINGLE, size), np.flatnonzero(sizes == size)
            for k in own:
                begin = np.arange(words.first[k], words.first[k + 1] - g + 1)
                self.grams[int(k)] = words.runs(begin, begin + g)
                by_gram.setdefault(g, []).append((self.grams[int(k)], size))
            prints = np.stack([fingerprint(_signs(self.grams[int(k)]).sum(axis=0)) for k in own])
            self.classes[size] = (own, prints, [_table(prints[:, j]) for j in range(BLOCKS)])
        self.known = {}
        for g, lists in by_gram.items():
            keys = np.unique(np.concatenate([x for x, _ in lists]))
            lengths = {size: np.isin(keys, np.concatenate([x for x, s in lists if s == size])) for size in {s for _, s in lists}}
            table = np.zeros(1 << _FILTER, bool)
            table[(keys >> _U(64 - _FILTER)).astype(np.int64)] = True
            self.known[g] = (keys, table, lengths)

    def leaks(self, texts: pa.Array, radius: int = RADIUS) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): for each text and item that match, the best window.

        A radius of 64 verifies every window and item that share a shingle.
        """
        words = Words(texts)
        for g, (keys, table, lengths) in self.known.items():
            grams, at = words.grams(g)
            maybe = np.flatnonzero(table[(grams >> _U(64 - _FILTER)).astype(np.int64)])
            key = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
            hit = keys[key] == grams[maybe]
            maybe, key = maybe[hit], key[hit]
            rows = np.searchsorted(at, maybe, side="right") - 1
            for row in np.unique(rows).tolist():
                here, there = maybe[rows == row] - at[row], key[rows == row]
                best: dict[int, tuple[float, int, int]] = {}
                for size, has in lengths.items():
                    self._windows(grams[at[row] : at[row + 1]], here[has[there]], size, g, best, radius)
                for k, (value, begin, n) in sorted(best.items()):
                    yield row, self.ids[k], begin, n, value

    def _windows(self, grams: np.ndarray, hits: np.ndarray, size: int, g: int, best: dict, radius: int) -> None:
        """Windows of `size` words that hold a hit: fingerprints, look-up, verification."""
        if not len(hits):
            return
        span = size - g + 1  # shingles of a window
        top = max(len(grams) - span, 0)
        starts = np.unique(np.clip((hits[:, None] - np.arange(span)).ravel(), 0, top))
        own, prints, near = self.classes[size]
        for k in range(0, len(starts), _CHUNK):
            some = starts[k : k + _CHUNK]
            for group in np.split(some, np.flatnonzero(np.diff(some) > span) + 1):  # neighbours share one running sum
                low, high = int(group[0]), min(int(group[-1]) + span, len(grams))
                total = np.zeros((high - low + 1, 64), np.int32)
                np.cumsum(_signs(grams[low:high]), axis=0, out=total[1:])
                found = fingerprint(total[np.minimum(group - low + span, high - low)] - total[group - low])
                if radius < 64:
                    windows, them = _looked_up(near, found, len(own))
                    near_enough = np.bitwise_count(found[windows] ^ prints[them]).sum(axis=1) <= radius
                    windows, them = windows[near_enough], them[near_enough]
                else:
                    windows, them = (x.ravel() for x in np.indices((len(group), len(own))))
                for a, b in zip(windows, them):
                    item, begin = int(own[b]), int(group[a])
                    window = grams[begin : begin + span]
                    value = weighted_similarity(window, self.grams[item])
                    if value >= self.similarity and value > best.get(item, (0.0, 0, 0))[0]:
                        best[item] = (value, begin, len(window) + g - 1)


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple]]:
    """The benchmark's items, a bounded block at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    blocks = max(1, -(-items.count() // block_items))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        for a in range(0, len(rows), 2 * block_items):
            yield [tuple(x) for x in rows[a : a + 2 * block_items]]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, block_items: int = 2000, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each matching document and item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kinds = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)] + [T.StructField(n, t) for n, t in (("first_word", T.LongType()), ("n_words", T.LongType()), ("similarity", T.DoubleType()))])
    out = spark.createDataFrame([], kinds)
    for items in _blocks(benchmark, block_items):
        index = spark.sparkContext.broadcast(Index(items, similarity))  # of at most 2 * block_items items

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(index.value.leaks(part.column(1), radius))
                    if found:
                        rows = pa.array([x[0] for x in found], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *(pa.array([x[i] for x in found]) for i in range(1, 5))], names=kinds.names)

        out = out.union(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, kinds))
    return out


def measured_recall(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, block_items: int = 2000) -> tuple[int, int]:
    """(found, all): pairs of documents with ids divisible by 50 and items that the fingerprints find, of those that the
    similarity of every window with a common shingle finds."""
    some = docs.where("doc_id % 50 = 0")
    return benchmark_leaks(some, benchmark, similarity, block_items).count(), benchmark_leaks(some, benchmark, similarity, block_items, radius=64).count()


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, block_items: int = 2000) -> DataFrame:
    """The rows of docs without a leak: one pass for each block of the benchmark, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    place = docs.columns.index("text")
    for items in _blocks(benchmark, block_items):
        index = spark.sparkContext.broadcast(Index(items, similarity))

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    for x in index.value.leaks(part.column(place)):
                        keep[x[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
