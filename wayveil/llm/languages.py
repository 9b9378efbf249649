"""Language of documents by multilingual mixture inference.

Training counts, over all its rows, how often each language has each letter n-gram; n-grams are hashed to a table of fixed
size, so the model has languages x buckets numbers whatever the corpus. A text is lower-cased, cut into words (runs of
letters), and a word's likelihood in a language is that of its n-grams, with a mark for the word's ends.

A document is a mixture of languages: each of its words is drawn from one of them. Expectation-maximisation estimates the
proportions, for all documents of a slice at once. The set of languages is chosen by penalised likelihood: from the best
single language on, the language that adds most joins the set as long as it adds more than the penalty, a number times the
logarithm of the number of words. Where all languages together cannot add that much to the best single one, that one
stands without a search, as no set can do better. The prediction is the language with the largest
proportion in the set, its score that proportion.

A text that is null or holds no letter is "und" with score 0, and so is every text if no row can be learned from. Rows with
a null lang are not learned from; rows with a null id are neither held out nor lost. Each row is a document of its own, also
where ids repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, buffer_of, cut, scratch

#: The model is sent to every task: it may hold so many numbers at most.
MOST_NUMBERS = 1 << 25
_SLICE = 1 << 21
_U = np.uint64


class Letters:
    """Words of texts: lower-cased runs of letters, each between two marks; for each n-gram its bucket and its word."""

    def __init__(self, texts: pa.Array, sizes: tuple[int, ...], buckets: int):
        plain = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"\PL+", " ")
        raw, offsets = buffer_of(plain)
        # A space before, between and after the words of every text.
        n, rows = len(raw), len(offsets) - 1
        spaced = np.full(n + 2 * rows + max(sizes), 0x20, np.uint8)
        spaced[np.arange(n) + np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))] = raw
        inside = spaced != 0x20
        at = np.flatnonzero(inside)  # every byte of a word; its n-grams begin one byte before it
        new = ~inside[at - 1]
        self.first = np.flatnonzero(new)
        self.words = np.bincount(np.searchsorted(offsets + 2 * np.arange(rows + 1), at[new], side="right") - 1, minlength=rows)
        self.starts = np.concatenate([[0], np.cumsum(self.words)])
        self.buckets = []
        for size in sizes:
            key, within = spaced[at - 1].astype(_U) + _U(257 * size), np.ones(len(at), bool)
            for k in range(size - 1):
                byte = np.where(within, spaced[at + k], 0x20)  # after the word's end there are marks only
                key = key * _U(257) + byte
                within &= byte != 0x20
            key = (key ^ (key >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            self.buckets.append(((key ^ (key >> _U(32))) % _U(buckets)).astype(np.int64))

    def likelihoods(self, table: np.ndarray) -> np.ndarray:
        """Logarithms of each word's likelihood in each language. table: buckets x languages."""
        out = np.zeros((len(self.first), table.shape[1]))
        for bucket in self.buckets if len(self.first) else ():
            out += np.add.reduceat(table[bucket], self.first, axis=0)
        return out


def _by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    _, offsets = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


class Model:
    """Languages and the logarithms of their n-grams' shares."""

    def __init__(self, languages: list[str], shares: np.ndarray, sizes: tuple[int, ...]):
        self.languages, self.shares, self.sizes = languages, shares, sizes


def train(rows: DataFrame, sizes: tuple[int, ...] = (3,), buckets: int = 1 << 16, smoothing: float = 0.5) -> Model:
    """Counts over all rows (lang, text) whose lang is not null."""
    bounded_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _by_bytes(batch, 1):
                letters, langs = Letters(part.column(1), sizes, buckets), part.column(0).dictionary_encode()
                of_word = np.repeat(langs.indices.to_numpy().astype(np.int64) * buckets, letters.words)
                for bucket in letters.buckets:
                    place = np.repeat(of_word, np.diff(np.append(letters.first, len(bucket)))) + bucket
                    both = np.bincount(place, minlength=len(langs.dictionary) * buckets).reshape(-1, buckets)
                    for name, counts in zip(langs.dictionary.to_pylist(), both):
                        totals[name] = totals.get(name, 0) + counts
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    known = rows.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = cut(known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = [r.lang for r in counted.select("lang").distinct().orderBy("lang").limit(MOST_NUMBERS // buckets + 1).collect()]
    if len(languages) * buckets > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS // buckets} languages; take fewer buckets")
    found = counted.toArrow()  # languages x buckets rows at most
    table = np.full((buckets, len(languages)), smoothing)
    if languages:
        place = pc.index_in(found["lang"], pa.array(languages)).to_numpy()
        table[found["bucket"].to_numpy(), place] += found["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)), sizes)


def _mixed(odds: np.ndarray, starts: np.ndarray, allowed: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and log-likelihood of each document, by EM until they move by less than `close`.

    odds: words x languages, each word's likelihoods divided by its largest; starts: first word of each document, which has one at least.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(np.append(starts, len(odds)))
    doc = np.repeat(np.arange(len(starts)), n)
    live, out, likely = np.arange(len(starts)), share.copy(), np.zeros(len(starts))
    while len(live):
        weight = odds * share[doc]
        total = weight.sum(axis=1)
        likely[live] = np.add.reduceat(np.log(total), starts)
        new = np.add.reduceat(weight / total[:, None], starts, axis=0) / n[:, None]
        moved = np.abs(new - share).max(axis=1) >= close
        out[live] = share = new
        if not moved.all():  # documents that have settled leave
            words = moved[doc]
            odds, share, n, live = odds[words], share[moved], n[moved], live[moved]
            starts, doc = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64), np.repeat(np.arange(len(n)), n)
    return out, likely


def _open(odds: np.ndarray, starts: np.ndarray, best: np.ndarray, least: np.ndarray, close: float) -> np.ndarray:
    """Documents whose log-likelihood under all languages together can pass `least`.

    EM begins beside the best single language. At any proportions, no others reach more than the number of words times the
    logarithm of the largest factor by which a step of EM would multiply a proportion; so most documents leave at once.
    """
    n, languages = np.diff(np.append(starts, len(odds))), odds.shape[1]
    if languages == 1:
        return np.zeros(0, np.int64)
    aside = 0.5 / (n + 1)
    share = np.repeat((aside / (languages - 1))[:, None], languages, axis=1)
    share[np.arange(len(n)), best] = 1 - aside
    live, doc, passed = np.arange(len(n)), np.repeat(np.arange(len(n)), n), np.zeros(len(n), bool)
    while len(live):
        total = np.einsum("ij,ij->i", odds, share[doc])
        likely = np.add.reduceat(np.log(total), starts)
        factor = np.add.reduceat(odds / total[:, None], starts, axis=0) / n[:, None]
        new = share * factor
        over = (likely > least[live]) | (np.abs(new - share).max(axis=1) < close * aside[live])
        under = likely + n * np.log(factor.max(axis=1)) <= least[live]
        passed[live[over & ~under]] = True
        stay = ~over & ~under
        share = new
        if not stay.all():
            odds, share, n, live = odds[stay[doc]], share[stay], n[stay], live[stay]
            starts, doc = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64), np.repeat(np.arange(len(n)), n)
    return np.flatnonzero(passed)


def proportions(words: np.ndarray, starts: np.ndarray, penalty: float = 2.0, close: float = 1e-3) -> np.ndarray:
    """Documents x languages: each document's proportions over the set with the best penalised likelihood.

    words: words x languages, logarithms of likelihoods; starts: as many as documents, each with a word.
    """
    top = words.max(axis=1, keepdims=True)
    odds = np.exp(np.maximum(words - top, -200))
    n = np.diff(np.append(starts, len(words)))
    cost = penalty * np.log(n + 1.0)
    single = np.add.reduceat(np.maximum(words - top, -200), starts, axis=0)
    best = single.argmax(axis=1)
    languages = words.shape[1]
    chosen = np.zeros((len(starts), languages), bool)
    chosen[np.arange(len(starts)), best] = True
    out, likely = chosen.astype(float), single.max(axis=1)
    open_ = _open(odds, starts, best, likely + cost, close)
    while len(open_):
        words_of = np.repeat(np.isin(np.arange(len(starts)), open_), n)
        some, at = odds[words_of], np.concatenate([[0], np.cumsum(n[open_])])[:-1].astype(np.int64)
        gained, new = np.full(len(open_), -np.inf), np.full(len(open_), -1)
        shares = out[open_].copy()
        for k in range(languages):
            free = ~chosen[open_, k]
            if not free.any():
                continue
            wide = chosen[open_] | (np.arange(languages) == k)
            share, found = _mixed(some, at, wide, close)
            better = free & (found - likely[open_] > gained)
            gained[better], new[better], shares[better] = (found - likely[open_])[better], k, share[better]
        joins = gained > cost[open_]
        rows = open_[joins]
        chosen[rows, new[joins]] = True
        out[rows], likely[rows] = shares[joins], likely[rows] + gained[joins]
        open_ = rows[~chosen[rows].all(axis=1)]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, penalty: float = 2.0) -> DataFrame:
    """doc_id, lang_pred, score, mixture (languages of the set with their proportions, largest first) of every row of docs."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = pa.array(known.languages, pa.string())
        kind = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            for part in _by_bytes(batch, 1):
                letters = Letters(part.column(1), known.sizes, len(known.shares))
                full = np.flatnonzero(letters.words) if known.languages else np.zeros(0, np.int64)
                share = np.zeros((part.num_rows, max(len(known.languages), 1)))
                if len(full):
                    share[full] = proportions(letters.likelihoods(known.shares), letters.starts[:-1][full], penalty)
                best, score = share.argmax(axis=1), np.minimum(share.max(axis=1), 1.0)
                lang = names.take(pa.array(best, mask=score == 0)) if known.languages else pa.nulls(part.num_rows, pa.string())
                order = np.argsort(-share, axis=1, kind="stable")
                mixture = [[(known.languages[k], float(row[k])) for k in by if row[k] > 0] for row, by in zip(share, order)]
                yield pa.RecordBatch.from_arrays([part.column(0), lang.fill_null("und"), pa.array(score), pa.array(mixture, kind)], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(guess, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def languages(docs: DataFrame, penalty: float = 2.0, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture of every row of docs (doc_id, text, lang), learned from rows that are not held out."""
    with scratch(docs.sparkSession):
        model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"), **parameters)
    return predict(docs, model, penalty).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
