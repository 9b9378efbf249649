"""What the training-data operators share: cut tables, bounded Arrow batches, word and shingle hashing.

Words are maximal runs of bytes other than space and the bytes 0x09-0x0D, with A-Z lower-cased. Their hashes are
computed for a whole Arrow buffer at once, a few nanoseconds a byte, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayveil.functions.tables import cut, scratch, shared_folder  # noqa: F401
from wayveil.functions.workers import ready

SHINGLE = 5
SLICE_BYTES = 4 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xD1342543DE82EF95
_WORD_INV = pow(_WORD_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so long texts do not fill a Python worker."""
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


#: Words of 64 bits of a bitmap of keys, 1 MB whatever the number of keys.
BITMAP_WORDS = 1 << 17


def marked(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Adds _hit, true where the key's bit is set in a bitmap of the wanted keys (the one column of `wanted`).

    All wanted keys are hit, and so many others as the bitmap is full; the exact join that follows then moves no other rows.
    The bitmap has at most BITMAP_WORDS rows, so it can be sent to every task.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_WORDS))
    one = lambda c: F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]), (F.pmod(F.shiftrightunsigned(F.xxhash64(c), 40), F.lit(64)) + 1).cast("int"))
    name = wanted.columns[0]
    bitmap = cut(wanted.select(word(F.col(name)).alias("_word"), one(F.col(name)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    both = rows.join(F.broadcast(bitmap), word(key) == F.col("_word"), "left")
    return both.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(one(key)) != 0, F.lit(False))).drop("_word", "_bits")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, _U)
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most `most` bytes together, one row at least."""
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """All words of a slice of texts: hash, byte start and end, and for each text the range of its words."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = buffer_of(texts)
        raw, n = self.raw, len(self.raw)
        inside = ~_SPACE[raw]
        if n:
            first = np.zeros(n, bool)
            first[self.offsets[:-1][self.offsets[:-1] < n]] = True
            before = np.zeros(n, bool)
            before[1:] = inside[:-1]
            self.starts = np.flatnonzero(inside & (first | ~before))
            after, last = np.zeros(n, bool), np.zeros(n, bool)
            after[:-1] = inside[1:]
            last[self.offsets[1:][self.offsets[1:] > 0] - 1] = True
            self.ends = np.flatnonzero(inside & (last | ~after)) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.hash = self._hash()
        self.first = np.searchsorted(self.starts, self.offsets)  # words of text i: first[i]:first[i + 1]

    def _hash(self) -> np.ndarray:
        out = np.zeros(len(self.starts), _U)
        at = 0
        while at < len(self.starts):  # a stretch of bytes at a time bounds the memory for very long texts
            begin = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, begin + SLICE_BYTES, side="right")))
            end = self.ends[upto - 1]
            total = np.zeros(end - begin + 1, _U)
            np.cumsum((_LOWER[self.raw[begin:end]].astype(_U) + _U(1)) * powers(_BASE, end - begin), out=total[1:])
            s, e = self.starts[at:upto] - begin, self.ends[at:upto] - begin
            out[at:upto] = (total[e] - total[s]) * powers(_BASE_INV, end - begin)[s] + (e - s).astype(_U)
            at = upto
        return mix(out)

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs begin[i]:end[i]."""
        total = np.zeros(len(self.hash) + 1, _U)
        np.cumsum(self.hash * powers(_WORD_BASE, len(self.hash)), out=total[1:])
        inv = powers(_WORD_INV, len(self.hash) + 1)
        return mix((total[end] - total[begin]) * inv[begin] + (end - begin).astype(_U))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words inside a text, by first word, and for each text the range of its runs."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        ranges = np.concatenate([[0], np.cumsum(counts)])
        begin = np.repeat(self.first[:-1] - ranges[:-1], counts) + np.arange(ranges[-1])
        return self.runs(begin, begin + size), ranges

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of each text; a text with fewer words than `size` has its whole sequence as the only one."""
        n = np.diff(self.first)
        counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        ranges = np.concatenate([[0], np.cumsum(counts)])
        begin = np.repeat(self.first[:-1] - ranges[:-1], counts) + np.arange(ranges[-1])
        return self.runs(begin, np.minimum(begin + size, np.repeat(self.first[1:], counts))), ranges


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct arrays; empty sets never."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
