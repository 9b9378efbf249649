"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a space and the text into tokens that have byte ranges. Tokens of the two that overlap are linked; the
byte offsets where tokens of both end cut the text into groups. A task labels the groups of a slice of documents at once
by pointer jumping: every token points to the overlapping token that ends farthest to the right (itself, or the first
tokenizer's token where both end together), and doubling the pointers, pointer[pointer], converges to the last token of
the first tokenizer in each group after a number of steps that is logarithmic in the longest group.

The links' corpus-wide counts follow token_count's way: about BATCH_BYTES of documents become one row, with its distinct id
pairs and how many of its documents hold each; these rows are written once, the pairs of all batches meet, and their
counts go back to the batches and are summed there by document. A very common pair has one row a batch, so it makes no
hot key, and an id of the first tokenizer has at most as many pairs as the second has ids.

A text that is null or empty, or whose tokens do not give back its bytes, has no tokens: zeros and an empty string. Strings
of special tokens in texts are plain text. Each row of the table is a document of its own, also where ids repeat or are
null; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches, cut, scratch

BATCH_BYTES = 8 << 20
#: Bytes of text that are aligned at once.
_SLICE = 1 << 20
_LONGEST = 64
_MOST = 200_000
_BATCH = "batch long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, holds array<long>, entries binary, places binary, often binary"
_FIELDS = [x.split()[0] for x in _BATCH.split(", ")]


class Words(dict):
    """Ids of stretches of text as packed integers, each made when first asked for; long ones are not kept."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids


class _Tokenizer:
    """Ids of texts, and the bytes of each id."""

    def __init__(self, cuts: Callable[[str], list[str]], encode: Callable[[str], list[int]], parts: list[bytes]):
        self.cuts, self.encode, self.parts = cuts, encode, parts
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.words = Words(encode)

    def ids(self, text: str) -> np.ndarray:
        if len(self.words) > _MOST:
            self.words = Words(self.encode)
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.cuts(text))), np.uint32)

    def gives(self, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(self.parts.__getitem__, ids.tolist())) == raw


def _byte_level(path: str) -> _Tokenizer:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""
    model = bpe.load(path)
    shown = {chr(model._bytes.get(b, b)): b for b in range(256)}
    names = [model.library.id_to_token(i) or "" for i in range(model.size)]
    parts = [name.encode() if name in model.added else bytes(shown[c] for c in name) for name in names]
    return _Tokenizer(model._plain, lambda word: [t.id for t in model._pieces(word)], parts)


def _pieces(path: str) -> _Tokenizer:
    """A sentencepiece file. It gets a space and the text, and adds that space itself.

    Where no piece holds a space after another character, pieces never cross from a word to the next space, so words are
    encoded one by one and kept; otherwise, or where the model changes texts, whole texts are.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model, stated = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_model_pb2.ModelProto()
    stated.ParseFromString(model.serialized_model_proto())
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    parts = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
    rules, kind = stated.normalizer_spec, stated.trainer_spec
    apart = kind.model_type == 2 and not kind.treat_whitespace_as_suffix and rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
    apart = apart and "▁" in names and not any(re.search("[^▁]▁", name) for name in names)
    cuts = re.compile(" +[^ ]*|[^ ]+").findall if apart else lambda text: [text]
    space = [names.index("▁")] if apart else []
    return _Tokenizer(cuts, lambda word: model.encode(word[1:], num_threads=1) if len(word) > 1 else space, parts)


@functools.lru_cache(2)
def _load(path: str) -> _Tokenizer:
    """One instance for each worker process and file."""
    return _pieces(path) if path.endswith(".model") else _byte_level(path)


def labelled(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group (0, 1, ...) of each token of both sequences, and the first overlapping token of the second for each of the first.

    ends: byte offsets at which the tokens end, ascending; both sequences cover the same bytes.
    """
    n = len(ends_a)
    starts_a, starts_b = np.concatenate([[0], ends_a])[:-1], np.concatenate([[0], ends_b])[:-1]
    last_b = np.searchsorted(starts_b, ends_a, side="left") - 1  # the last token of b that overlaps a's
    last_a = np.searchsorted(starts_a, ends_b, side="left") - 1
    point = np.concatenate([np.where(ends_b[last_b] > ends_a, n + last_b, np.arange(n)), np.where(ends_a[last_a] >= ends_b, last_a, n + np.arange(len(ends_b)))]) if n else np.zeros(0, np.int64)
    while not np.array_equal(jumped := point[point], point):
        point = jumped
    place = np.cumsum(point[:n] == np.arange(n)) - 1  # terminals stand in text order
    label = place[point] if n else point
    return label[:n], label[n:], np.searchsorted(ends_b, starts_a, side="right")


@functools.lru_cache(2)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the decimal numbers below size with room for a separator, and their lengths with it."""
    width = len(str(size)) + 1
    lengths = np.array([len(str(i)) + 1 for i in range(size)])
    return np.array([list(str(i).encode().ljust(width, b" ")) for i in range(size)], np.uint8), lengths


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; ... as characters, and where each group's text ends. size: above every id."""
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    every, close = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    every[at_a], every[at_b] = a, b
    close[at_a[np.append(group_a[1:] != group_a[:-1], True)[: len(a)]]] = ord("|")
    close[at_b[np.append(group_b[1:] != group_b[:-1], True)[: len(b)]]] = ord(";")
    table, lengths = _digits(size)
    chars, wide = table[every], lengths[every]
    chars[np.arange(len(every)), wide - 1] = close
    return chars[np.arange(chars.shape[1]) < wide[:, None]], np.cumsum(wide)[close == ord(";")]


class _Aligned:
    """What a batch has of its documents so far."""

    def __init__(self, a: _Tokenizer, b: _Tokenizer):
        self.a, self.b = a, b
        self.ids: list[int | None] = []
        self.sums: list[np.ndarray] = []
        self.groups: list[str] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        """Documents of a slice: their numbers, groups, and distinct pairs by document with their occurrences."""
        found = [self._tokens(x) for x in texts]
        a, b = np.concatenate([x for x, _ in found]).astype(np.int64), np.concatenate([x for _, x in found]).astype(np.int64)
        n_a, n_b = np.array([len(x) for x, _ in found]), np.array([len(x) for _, x in found])
        group_a, group_b, first = labelled(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        starts_b = np.cumsum(self.b.lengths[b]) - self.b.lengths[b]
        each = np.searchsorted(starts_b, np.cumsum(self.a.lengths[a]), side="left") - first
        doc_of_a = np.repeat(np.arange(len(ids)), n_a)
        left = np.repeat(np.arange(len(a)), each)
        right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        size_a, size_b = len(self.a.parts), len(self.b.parts)
        keys, often = np.unique((doc_of_a[left] * size_a + a[left]) * size_b + b[right], return_counts=True)
        doc, pair = np.divmod(keys, size_a * size_b)
        self.links.append(((pair // size_b << 32) | pair % size_b, doc + len(self.ids), often))
        # A group's document is that of its tokens.
        ends_a = np.flatnonzero(np.concatenate([group_a[1:] != group_a[:-1], [True]])[: len(a)])
        n_groups = np.bincount(doc_of_a[ends_a], minlength=len(ids))
        chars, ends = _written(a, b, group_a, group_b, max(size_a, size_b))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_groups)])]
        said = chars.tobytes()
        self.groups += [said[x : y - 1].decode() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:])]
        self.sums.append(np.stack([n_a, n_b, n_groups, np.bincount(doc, often, len(ids)).astype(np.int64)]))
        self.ids += ids

    def _tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.uint32)
        if not text:
            return none, none
        whole = " " + text
        raw = whole.encode()
        self.held += len(raw)
        a, b = self.a.ids(whole), self.b.ids(whole)
        return (a, b) if self.a.gives(a, raw) and self.b.gives(b, raw) else (none, none)

    def row(self, number: int) -> pa.RecordBatch:
        keys, docs, often = (np.concatenate([x[k] for x in self.links]) for k in range(3))
        pairs, places = np.unique(keys, return_inverse=True)
        holds = np.bincount(places, minlength=len(pairs))
        entries = np.bincount(docs, minlength=len(self.ids))
        sums = np.concatenate(self.sums, axis=1)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        packed = lambda x: pa.array([zstandard.compress(x.astype("<u4").tobytes())], pa.binary())
        columns = [pa.array([number]), one(self.ids, pa.int64()), *(one(x, pa.int64()) for x in sums), one(self.groups, pa.string()), one(pairs, pa.int64()), one(holds, pa.int64()), packed(entries), packed(places), packed(often)]
        return pa.RecordBatch.from_arrays(columns, names=_FIELDS)


def _align(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, made = _load(path_a), _load(path_b), 0
        held = _Aligned(a, b)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                upto, size = at, 0
                while upto < len(ids) and (upto == at or size < _SLICE):
                    size += len(texts[upto] or "")
                    upto += 1
                held.add(ids[at:upto], texts[at:upto])
                at = upto
                if held.held >= BATCH_BYTES or len(held.ids) >= 60_000:
                    yield held.row((TaskContext.get().partitionId() << 32) + made)
                    held, made = _Aligned(a, b), made + 1
        if held.ids:
            yield held.row((TaskContext.get().partitionId() << 32) + made)

    return work


def batches(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """A table of batches of documents. shown: what is kept of each document's groups, the whole string by default."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_align(tokenizer_a, tokenizer_b), _BATCH)
    return cut(rows.withColumn("groups", F.transform("groups", shown)) if shown else rows)


def _each_pair(table: DataFrame) -> DataFrame:
    """batch, place, pair, holds: the distinct id pairs of each batch."""
    both = F.arrays_zip(F.col("pairs").alias("pair"), F.col("holds").alias("holds"))
    return table.select("batch", F.posexplode(both).alias("place", "x")).select("batch", "place", "x.pair", "x.holds")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, a, b, n (documents that hold the id pair linked), best (n is the highest of the pairs of its a)."""
    counts = _each_pair(table).groupBy("pair").agg(F.sum("holds").alias("n")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.join(top, "a").select("pair", "a", b.alias("b"), "n", (F.col("n") == F.col("top")).alias("best"))


def _total(batch: pa.Table, counted: pa.Table) -> pa.Table:
    """Documents of one batch with the sums over their links."""
    entries, places, often = (np.frombuffer(zstandard.decompress(batch[x][0].as_py()), "<u4") for x in ("entries", "places", "often"))
    n, best = np.zeros(len(counted), np.int64), np.zeros(len(counted), np.int64)
    at = counted["place"].to_numpy()
    n[at], best[at] = counted["n"].to_numpy(), counted["best"].to_numpy()
    upto = np.concatenate([[0], np.cumsum(entries, dtype=np.int64)])
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x * often)])[upto])
    own = {x: batch[x][0].values for x in ("n_a", "n_b", "n_groups", "n_links")}
    return pa.table({"doc_id": batch["ids"][0].values, **own, "n_best": summed(best[places]), "count_sum": summed(n[places]), "groups": batch["groups"][0].values})


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for every row of docs (doc_id, text).

    groups: a1,a2|b1;a3|b2,b3 - the ids of both tokenizers, group by group; `shown` makes another string of it. n_best
    counts the links whose pair is in as many documents as any pair of its first id, count_sum adds their documents.
    tokenizer_a, tokenizer_b: paths, found on every executor, of a byte-level BPE file of the tokenizers library (.json)
    or of a sentencepiece file (.model); the latter must add the leading space itself.
    """
    with scratch(docs.sparkSession) as keep:
        table = batches(docs, tokenizer_a, tokenizer_b, shown)
        counted = _each_pair(table).drop("holds").join(pair_counts(table).select("pair", "n", "best"), "pair").select(F.col("batch").alias("of"), "place", "n", "best")
        out = table.drop("pairs", "holds").groupBy("batch").cogroup(counted.groupBy("of")).applyInArrow(
            lambda a, b: _total(a, b), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        )
        return keep(cut(out))
