"""Substring dedup by sliding sentence spans.

A sentence ends at a word whose last byte is one of BREAKS, at a line feed, or at the text's end. From every sentence on,
the shortest run of at least `least_sentences` sentences with `least_words` words is hashed (96 bits). Runs are counted
over the whole corpus, before the shuffle as far as they meet in a task; a run that occurs more than once keeps its first
place (smallest id, then position), and every word under a run at another place is removed.

Repeated passages need not hold two whole sentences (lists, tables, passages that begin and end inside sentences), so with
`passage_words` runs of SEED words are hashed too, chosen by winnowing: of every passage_words - SEED + 1 neighbouring runs
those with the smallest hash. Two places that share passage_words words choose the same run inside them, whatever stands
around it, so each such repeat is found; neighbouring runs overlap, so only words near a passage's ends can stay. The first
and the last run of a text are chosen as well, so whole copies go with their ends.

Copies of whole documents lose all sentences that a run covers, in all documents but the first. Nulls and texts with too
few sentences have no run and stay as they are. Rows with a null id come after all others. A document is an id and a text:
texts under one id are documents of their own, ordered by the texts' hashes, and rows that repeat both are one document,
which loses the same words in each row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, bounded_batches, cut, marked, mix, slices

BREAKS = b".!?"
SEED = 32
_RUNS = "a long, b int, doc_id long, text_key long, first int, last int"
_OUT = "doc_id long, text_key long, n_sentences long, n_removed long, removed array<struct<start:long,end:long>>, text string"


class Sentences:
    """Sentences of a slice of texts as ranges of words; their bytes end where the next sentence begins."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        ends = np.isin(w.raw[w.ends - 1], np.frombuffer(BREAKS, np.uint8)) if len(w.ends) else np.zeros(0, bool)
        feeds = np.concatenate([[0], np.cumsum(w.raw == 10)])
        ends[:-1] |= feeds[w.starts[1:]] > feeds[w.ends[:-1]]
        ends[w.first[1:][np.diff(w.first) > 0] - 1] = True
        self.upto = np.flatnonzero(ends) + 1  # a sentence's words: upto[i - 1]:upto[i]
        self.begin = np.concatenate([[0], self.upto[:-1]]) if len(self.upto) else self.upto
        self.first = np.searchsorted(self.begin, w.first)  # sentences of text i: first[i]:first[i + 1]


def _seeds(words: Words, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chosen runs of SEED words, and the texts they stand in."""
    width = passage_words - SEED + 1
    hashes, ranges = words.grams(SEED)
    counts, n = np.diff(ranges), len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - ranges[:-1][text]
    chosen = (counts[text] >= width) & ((place == 0) | (place == counts[text] - 1))
    if n >= width:
        low = np.lib.stride_tricks.sliding_window_view(hashes, width).min(axis=1)
        low[text[: n - width + 1] != text[width - 1 :]] = 0
        # A run is chosen if it is the smallest of some window that holds it; windows over two texts count as 0.
        edge = np.zeros(width - 1, np.uint64)
        chosen |= np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, low, edge]), width).max(axis=1) == hashes
    at = np.flatnonzero(chosen)
    return words.first[:-1][text[at]] + place[at], text[at]


def _runs(least_sentences: int, least_words: int, passage_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sentences(part.column(2))
                text = np.repeat(np.arange(part.num_rows), np.diff(s.first))
                k = np.arange(len(s.begin))
                last = np.maximum(k + least_sentences - 1, np.searchsorted(s.upto, s.begin + least_words))
                ok = last < s.first[1:][text]
                k, last, text = k[ok], last[ok], text[ok]
                begin, upto, salt = s.begin[k], s.upto[last], np.zeros(len(k), np.uint64)
                if passage_words:
                    seeds, of = _seeds(s.words, passage_words)
                    begin, upto, text = np.concatenate([begin, seeds]), np.concatenate([upto, seeds + SEED]), np.concatenate([text, of])
                    salt = np.concatenate([salt, np.full(len(seeds), SEED, np.uint64)])
                hashes = s.words.runs(begin, upto) ^ salt
                other = mix(s.words.runs(begin, upto - 1) ^ s.words.hash[upto - 1])
                base = s.words.first[:-1][text]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array((other >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array((begin - base).astype(np.int32)), pa.array((upto - 1 - base).astype(np.int32))], names=[x.split()[0] for x in _RUNS.split(", ")])

    return work


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            s = Sentences(part.column(2))
            spans = part.column(3).to_pylist()
            sizes, counts, taken, kept = [], [], [], []
            for i in range(part.num_rows):
                begin, n = s.words.first[i], int(s.words.first[i + 1] - s.words.first[i])
                gone = np.zeros(n + 1, np.int64)
                for x in spans[i]:
                    gone[x["first"]] += 1
                    gone[x["last"] + 1] -= 1
                gone = np.cumsum(gone[:n]) > 0
                # bytes of word k: from its start to the next word's start
                starts = s.words.starts[begin : begin + n] - s.words.offsets[i]
                stops = np.append(starts[1:], s.words.offsets[i + 1] - s.words.offsets[i])
                raw = s.words.raw[s.words.offsets[i] : s.words.offsets[i + 1]]
                keep = np.ones(len(raw), bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                removed = [(int(starts[a]), int(stops[b - 1])) for a, b in edges.reshape(-1, 2)]
                for a, b in removed:
                    keep[a:b] = False
                own = s.begin[s.first[i] : s.first[i + 1]] - begin
                sizes.append(len(own))
                counts.append(int(np.logical_and.reduceat(gone, own).sum()))
                taken.append([{"start": a, "end": b} for a, b in removed])
                kept.append(raw[keep].tobytes().decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(taken, kind), pa.array(kept, pa.string())], names=["doc_id", "text_key", "n_sentences", "n_removed", "removed", "text"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: a document's key and its text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 16, passage_words: int = 0) -> DataFrame:
    """(doc_id, text_key, first, last, first_doc): runs of words that are not the first of their kind."""
    bounded_batches(docs.sparkSession)
    runs = _keyed(docs).mapInArrow(_runs(least_sentences, least_words, passage_words), _RUNS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("first"))
    # Written, so that both sides of the join are dealt by the join alone and a very common run can be split.
    often = cut(runs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where("n > 1").drop("n"))
    both = runs.join(often, ["a", "b"])
    return both.where(place != F.col("origin")).select("doc_id", "text_key", "first", "last", F.col("origin.doc_id").alias("first_doc"))


def span_dedup(docs: DataFrame, least_sentences: int = 2, least_words: int = 16, passage_words: int = 0) -> DataFrame:
    """For every document that loses words: n_sentences, n_removed, removed byte ranges, text without them, first_docs.

    n_removed counts sentences that are gone whole. passage_words: repeats of so many words (more than SEED) are found
    wherever sentences end; 0 leaves them to the runs of sentences.
    first_docs: ids of the documents that keep the first places of what was removed, each once. text_key: hash of the text.
    """
    spans = cut(repeated_spans(docs, least_sentences, least_words, passage_words).distinct())
    # A document's spans grow with the document alone, its first_docs at most as much.
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text"))
    grouped = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).agg(F.collect_list(F.struct("first", "last")).alias("spans"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    grouped = cut(grouped)
    # Only texts whose id has spans move to meet them.
    some = marked(_keyed(docs), F.col("doc_id"), grouped.select("_id")).where("_hit")
    out = some.join(grouped.drop("first_docs"), key).select("doc_id", "text_key", "text", "spans").mapInArrow(_cut_out, _OUT)
    return out.join(grouped.drop("spans"), key).drop("_id", "_text")
