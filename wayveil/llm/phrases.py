"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and those into words. A word whose hash is a
multiple of `every` is a trigger. Each piece is parsed into chunks that begin at its first word and at every trigger and
reach over the next trigger by the longest phrase's length less one, so every run of words that a phrase can be lies whole
inside the chunk in which it begins; that chunk alone counts it, so overlaps count once. Equal stretches of text give equal
chunks, whatever stands around them: copies and common passages collapse to one row of the dictionary with a frequency.

1. The dictionary: distinct (lang, chunk) with the number of its words that begin phrases and its frequency, a table.
2. Words are counted inside the distinct chunks, weighted. Longer phrases follow one length after the other, first by
   64-bit hashes, where both parts one word shorter can be frequent enough: a batch of chunks sends each bucket of hashes
   one row. Hashes that reach the least count are marked in a bitmap of fixed size, and the phrases that are marked, a few
   others among them, are counted as strings. These counts are exact and decide.
3. Candidates get the counts of their parts from shorter phrases, the score of their lowest cut, and the most frequent
   longer candidate that holds them. A word that begins or ends very many phrases is dealt over SALTS tasks.

Numbers are exact: counts are long, products decimals of 38 digits (all the corpus may hold 10**15 words). A null text is
empty, a null lang is "und". Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import _BASE, _LOWER, Words, bounded_batches, buffer_of, cut, mix, powers, scratch, slices

#: Bytes that end a piece (. , ; : ! ? and 0x0A-0x0D) and that part words (space and tab).
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_U = np.uint64
#: A bitmap of frequent phrases has 2 ** PLACE bits, 4 MB, whatever their number.
PLACE = 25
#: Chunks of the dictionary that a bucket of hashes stands for, about.
BUCKET = 1 << 17
SALTS = 16
#: Bytes of chunks that are counted together in a task.
_FLUSH = 8 << 20


class Pieces(Words):
    """The words of a slice of texts, and for each word the piece that it stands in."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = buffer_of(texts)
        self.raw = _LOWER[self.raw]
        n = len(self.raw)
        ends, gap = _PIECE[self.raw], _GAP[self.raw]
        inside = ~(ends | gap)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (first[:-1] | ~before))
        self.ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        self.hash = self._hash()
        self.piece = (np.cumsum(ends) + np.cumsum(first[:-1]))[self.starts] if n else np.zeros(0, np.int64)
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1

    def joined(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The word runs begin[i]:end[i] as strings, words parted by one space."""
        sizes = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(self.starts - at[:-1], sizes) + np.arange(at[-1])
        spaced = self.raw[np.minimum(flat, max(len(self.raw) - 1, 0))] if len(flat) else np.zeros(0, np.uint8)
        spaced[at[1:] - 1] = 0x20
        lengths = at[end] - at[begin] - 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        chars = spaced[np.repeat(at[begin] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars))


def _chunks(most: int, every: int):
    """Partial dictionaries: (lang, chunk, own, freq)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Pieces(part.column(1))
                n = len(words.starts)
                if not n:
                    continue
                new = np.append(True, words.piece[1:] != words.piece[:-1])
                begin = np.flatnonzero(new | (words.hash % _U(every) == 0))
                upto = np.append(begin[1:], n)
                piece_end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1][begin]
                end = np.minimum(upto + most - 1, piece_end)
                lang = part.column(0).take(pa.array(words.text[begin]))
                table = pa.table({"lang": lang, "chunk": words.joined(begin, end), "own": pa.array((upto - begin).astype(np.int32))})
                found = table.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")])
                columns = [found["lang"], found["chunk"].cast(pa.string()), found["own"], found["count_all"]]
                yield from pa.table(columns, names=["lang", "chunk", "own", "freq"]).to_batches()

    return work


def dictionary(docs: DataFrame, most: int = 3, every: int = 16) -> DataFrame:
    """The parse: distinct (lang, chunk, own) with freq. own: how many of the chunk's words begin phrases."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parsed = rows.mapInArrow(_chunks(most, every), "lang string, chunk string, own int, freq long")
    return cut(parsed.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq")))


def _key(lang: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """One hash of the hashes of langs and phrases; its first bits are the place in the bitmap."""
    return mix(lang * _U(0x9E3779B97F4A7C15) + phrase)


def _marked(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key >> _U(64 - PLACE)
    return (bitmap[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


class _Grams:
    """The words of many chunks as integers, exact inside a task."""

    def __init__(self, table: pa.Table):
        self.own, self.freq = table["own"].to_numpy(), table["freq"].to_numpy()
        chunks = table["chunk"].combine_chunks()
        split = pc.split_pattern(chunks.cast(pa.large_string()), " ")
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        words = split.values.dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.offsets = split.offsets.to_numpy().astype(np.int64)
        self.sizes = np.diff(self.offsets)
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        chunk = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.chunk, self.inner = chunk, np.arange(len(chunk)) - self.offsets[:-1][chunk] + self.offsets[0]
        self.hash, self.lang_hash = Words(self.words).hash if len(self.words) else np.zeros(0, _U), _hashed(self.langs)

    def runs(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the runs of `size` words that begin at the places."""
        out = np.zeros(len(at), _U)
        for k in range(size):
            out = (out + self.hash[self.code[at + k]]) * _U(0xD1342543DE82EF95) + _U(1)
        return out

    def begins(self, size: int) -> np.ndarray:
        """Places of the words that begin runs of `size` words which their chunk counts."""
        return np.flatnonzero((self.inner < self.own[self.chunk]) & (self.inner + size <= self.sizes[self.chunk]))

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        return _key(self.lang_hash[self.lang[self.chunk[at]]], self.runs(at, size)) if len(at) else np.zeros(0, _U)

    def hoped(self, size: int, parts: np.ndarray) -> np.ndarray:
        """Places of runs whose parts, one word shorter, are both marked."""
        at = self.begins(size)
        for shift in (0, 1):
            at = at[_marked(parts, self.keys(at + shift, size - 1))]
        return at

    def summed(self, size: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of such runs, sorted, and their occurrences."""
        at = self.hoped(size, parts)
        keys, which = np.unique(self.keys(at, size), return_inverse=True)
        return keys, np.bincount(which, self.freq[self.chunk[at]], len(keys)).astype(np.int64)

    def counted(self, size: int, marks: np.ndarray | None = None) -> pa.Table:
        """lang, phrase, n: runs of `size` words, the marked ones only, if there are marks."""
        at = self.begins(size)
        at = at if marks is None else at[_marked(marks, self.keys(at, size))]
        key = self.lang[self.chunk[at]]
        for k in range(size):  # exact: the prefix's number and the word's
            key = np.unique(key, return_inverse=True)[1] * max(len(self.words), 1) + self.code[at + k]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        freq = np.zeros(len(first), np.int64)
        np.add.at(freq, which, self.freq[self.chunk[at]])
        one = at[first]
        phrase = self.words.take(pa.array(self.code[one])).cast(pa.large_string())
        for k in range(1, size):
            phrase = pc.binary_join_element_wise(phrase, self.words.take(pa.array(self.code[one + k])).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        return pa.table({"lang": self.langs.take(pa.array(self.lang[self.chunk[one]])).cast(pa.string()), "phrase": phrase.cast(pa.string()), "size": pa.array(np.full(len(one), size, np.int32)), "n": freq})


def _hashed(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of whole strings."""
    raw, offsets = buffer_of(strings)
    return np.array([mix(((raw[a:b].astype(_U) + _U(1)) * powers(_BASE, b - a)).sum(dtype=_U).reshape(1))[0] for a, b in zip(offsets[:-1], offsets[1:])], _U)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[_Grams]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.nbytes for x in held) >= _FLUSH:
            yield _Grams(pa.Table.from_batches(held))
            held = []
    if held:
        yield _Grams(pa.Table.from_batches(held))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for grams in _gathered(batches):
        yield from grams.counted(1).to_batches()


def _count(marks: dict):
    """Partial counts of the marked phrases of all sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _gathered(batches):
            for size, bitmap in marks.items():
                yield from grams.counted(size, np.frombuffer(bitmap.value, np.uint8)).to_batches()

    return work


def _hash(size: int, parts, bits: int):
    """A row for each batch and bucket, the first `bits` bits of hashes: sorted hashes and their occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _gathered(batches):
            keys, n = grams.summed(size, np.frombuffer(parts.value, np.uint8))
            buckets, begin = np.unique(keys >> _U(64 - bits), return_index=True)
            ends = np.append(begin[1:], len(keys))
            packed = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(begin, ends)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), packed(keys), packed(n)], names=["bucket", "keys", "n"])

    return work


def _reaching(least: int):
    """The words of 64 bits of the bitmap that a bucket's hashes with `least` occurrences mark."""

    def work(bucket: pa.Table) -> pa.Table:
        keys, n = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in bucket[c]]) for c, kind in (("keys", _U), ("n", np.int64)))
        order = np.argsort(keys)
        keys = keys[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        place = (keys[begin][np.add.reduceat(n[order], begin) >= least] >> _U(64 - PLACE)).astype(np.int64)
        word, which = np.unique(place >> 6, return_inverse=True)
        bits = np.zeros(len(word), np.int64)
        np.bitwise_or.at(bits, which, np.left_shift(np.int64(1), place & 63))
        return pa.table({"word": word, "bits": bits})

    return work


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of words (lang, phrase)."""
    for batch in batches:
        if batch.num_rows:
            ones = lambda kind: pa.array(np.ones(batch.num_rows, kind))  # noqa: B023, E731
            grams = _Grams(pa.table({"lang": batch.column(0), "chunk": batch.column(1), "own": ones(np.int32), "freq": ones(np.int64)}))
            place = (grams.keys(np.arange(batch.num_rows), 1) >> _U(64 - PLACE)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.int64(1), place & 63))], names=["word", "bits"])


def _sent(rows: DataFrame):
    """The bitmap of rows (word, bits), sent to every task."""
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** PLACE / 64 rows
    out = np.zeros((1 << PLACE) // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


def _parts(phrase: Column, words: int, k: int) -> tuple[Column, Column]:
    return F.substring_index(phrase, " ", k), F.substring_index(phrase, " ", k - words)


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """Adds the count of the phrase in column `key` (there, as it holds a candidate); common parts are dealt over SALTS tasks."""
    salted = counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(salted, ["lang", key, "_salt"]).drop("_salt")


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exactly; at most 1000000 as a is at most l and r."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    up, down = whole(F.lit(1_000_000), 7) * whole(a, 15) * whole(a, 15), whole(l, 15) * whole(r, 15)
    near = F.floor(up.cast("double") / down.cast("double")).cast("long")
    # The double is off by less than one; the products decide.
    reaches = lambda q: whole(q, 8) * down.cast("decimal(30,0)") <= up
    return F.when(reaches(near + 1), near + 1).when(reaches(near), near).otherwise(near - 1)


def collocations(docs: DataFrame, least: int = 10, most: int = 3, top: int = 2000, percent: int = 50, every: int = 16) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best `top` phrases of 2 to `most` words in docs (text, lang).

    least: occurrences of a candidate. percent: a candidate goes if a longer one holds it and has that share of its
    occurrences. every: one word in so many is a trigger.
    """
    with scratch(docs.sparkSession) as keep:
        parse = dictionary(docs, most, every)
        schema = "lang string, phrase string, size int, n long"
        words = cut(parse.mapInArrow(_words, schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
        total = cut(words.groupBy("lang").agg(F.sum("n").alias("total")))
        frequent = words.where(F.col("n") >= least)
        bits = max(6, min(PLACE, math.ceil(math.log2(parse.count() / BUCKET + 1)) + 4))
        parts, marks = _sent(frequent.select("lang", "phrase").mapInArrow(_mark, "word long, bits long")), {}
        for size in range(2, most + 1):
            hashed = parse.mapInArrow(_hash(size, parts, bits), "bucket long, keys binary, n binary")
            parts = marks[size] = _sent(hashed.groupBy("bucket").applyInArrow(_reaching(least), "word long, bits long"))
        phrases = cut(parse.mapInArrow(_count(marks), schema).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        counts = [frequent, *[phrases.where(F.col("size") == size).drop("size") for size in range(2, most + 1)]]
        scored, longer = [], []
        for size in range(2, most + 1):
            rows = counts[size - 1].withColumnRenamed("n", "a")
            for k in range(1, size):
                left, right = _parts(F.col("phrase"), size, k)
                rows = _looked_up(rows.withColumn("_left", left).withColumn("_right", right), "_left", counts[k - 1], f"_l{k}")
                rows = _looked_up(rows, "_right", counts[size - k - 1], f"_r{k}").drop("_left", "_right")
            each = [F.struct(score_of(F.col("a"), F.col(f"_l{k}"), F.col(f"_r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in range(1, size)]
            lowest = F.least(*each) if size > 2 else each[0]
            scored.append(rows.withColumn("cut", lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
            # The phrases of 2 words and more inside one of this size.
            inner = [(i, m) for m in range(2, size) for i in range(size - m + 1)]
            if inner:
                split = F.split("phrase", " ")
                longer.append(counts[size - 1].select("lang", F.explode(F.array(*[F.array_join(F.slice(split, i + 1, m), " ") for i, m in inner])).alias("phrase"), F.col("n").alias("holds")))
        every_one = functools.reduce(DataFrame.union, scored)
        if longer:
            held = functools.reduce(DataFrame.union, longer).groupBy("lang", "phrase").agg(F.max("holds").alias("holds"))
            every_one = every_one.join(held, ["lang", "phrase"], "left").where(F.col("holds").isNull() | (100 * F.col("holds") < percent * F.col("a"))).drop("holds")
        best = every_one.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
        return keep(cut(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")))
