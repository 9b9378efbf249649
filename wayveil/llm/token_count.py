"""Token counts without token ids.

A task turns about 32 MB of documents at a time (a batch) into one row: the batch's documents, its distinct pre-tokens,
and for each of those the documents that hold it and how often. These rows are written once. The pre-tokens of all
batches then meet, sorted, so each distinct pre-token of the corpus has its pieces counted once; the counts go back to the
batches, are joined to the frequencies there and summed by document. A very common pre-token has one row a batch, so it
makes no hot key.

Pre-tokens that are whole entries of the vocabulary are counted in the task, from a table whose size is the
vocabulary's. A null text counts as empty. Each input row gives one output row, also where ids repeat or are null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches, cut

BATCH_BYTES = 32 << 20
#: Documents of a batch: their numbers fit 16 bits.
_MOST = 60_000
_FREQUENCIES = "batch long, ids array<long>, n_bytes array<long>, base array<long>, tokens array<string>, entries binary, docs binary, often binary"


def _frequencies(path: str):
    """Rows of batches: `entries` tells how many of `docs` and `often`, in order, belong to each of `tokens`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, whole, made = bpe.load(path), _vocabulary(path), 0

        def flush() -> pa.RecordBatch:
            number = (TaskContext.get().partitionId() << 32) + made
            known = np.fromiter((whole.get(x, -1) for x in index), np.int32, len(index))
            which, doc = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
            base = np.bincount(doc, np.maximum(known, 0)[which], len(found)).astype(np.int64)
            place = np.cumsum(known < 0) - 1
            new = known[which] < 0
            entries, often = np.unique((place[which[new]] << 16) | doc[new], return_counts=True)
            names = [x for x, k in zip(index, known) if k < 0]
            each = np.bincount(entries >> 16, minlength=len(names))
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            packed = lambda x, kind: pa.array([zstandard.compress(x.astype(kind).tobytes())], pa.binary())
            columns = [pa.array([number]), one(ids, pa.int64()), one(sizes, pa.int64()), one(base, pa.int64()), one(names, pa.string()), packed(each, "<u4"), packed(entries & 0xFFFF, "<u2"), packed(often, "<u4")]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _FREQUENCIES.split(", ")])

        index, found, ids, sizes, held = defaultdict(count().__next__), [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pretokens = tokens.pretokens(text or "")
                found.append(np.fromiter(map(index.__getitem__, pretokens), np.int32, len(pretokens)))
                ids.append(doc_id)
                sizes.append(len((text or "").encode()))
                held += sizes[-1]
                if held >= BATCH_BYTES or len(ids) >= _MOST:
                    yield flush()
                    made += 1
                    index, found, ids, sizes, held = defaultdict(count().__next__), [], [], [], 0
        if ids:
            yield flush()

    return work


_known: dict[str, dict[str, int]] = {}


def _vocabulary(path: str) -> dict[str, int]:
    """Pieces of the vocabulary's own entries that are whole pre-tokens, and of the added tokens."""
    if path not in _known:
        tokens = bpe.load(path)
        every = [x for i in range(tokens.size) if (x := tokens.library.decode([i], skip_special_tokens=False)) and "�" not in x]
        whole = [x for x in dict.fromkeys(every) if x not in tokens.added and tokens.pretokens(x) == [x]]
        _known[path] = dict(zip(whole, tokens.pieces(whole))) | {x: 1 for x in tokens.added}
    return _known[path]


def _count(path: str):
    """Pieces of sorted pre-tokens: one count for a run of equal ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = bpe.load(path), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(2).cast(pa.large_string()))
            names = runs.values.to_pylist()
            pieces = [last[names[0]], *tokens.pieces(names[1:])] if names[0] in last else tokens.pieces(names)
            last = {names[-1]: pieces[-1]}
            n = np.repeat(np.array(pieces, np.int32), np.diff(runs.run_ends.to_numpy(), prepend=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["batch", "place", "pieces"])

    return work


def _total(batch: pa.Table, counted: pa.Table) -> pa.Table:
    """Documents of one batch with their sums."""
    ids, sizes, base = (batch[x][0].values for x in ("ids", "n_bytes", "base"))
    entries, docs, often = (np.frombuffer(zstandard.decompress(batch[x][0].as_py()), kind) for x, kind in (("entries", "<u4"), ("docs", "<u2"), ("often", "<u4")))
    pieces = np.zeros(len(entries), np.int64)
    pieces[counted["place"].to_numpy()] = counted["pieces"].to_numpy()
    total = base.to_numpy() + np.bincount(docs, often * np.repeat(pieces, entries), len(ids)).astype(np.int64)
    return pa.table({"doc_id": ids, "n_bytes": sizes, "n_tokens": pa.array(total)})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of docs (doc_id, text).

    tokenizer: path of a byte-level BPE file of the tokenizers library, found on every executor.
    """
    bounded_batches(docs.sparkSession)
    batches = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_frequencies(tokenizer), _FREQUENCIES))
    every = batches.select("batch", F.posexplode("tokens").alias("place", "token")).repartition("token").sortWithinPartitions("token")
    counted = every.mapInArrow(_count(tokenizer), "batch long, place int, pieces int")
    out = batches.drop("tokens").groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(lambda a, b: _total(a, b), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
