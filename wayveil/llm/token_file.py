"""Token ids in files, Huffman-coded.

Documents are sorted by id over range partitions, encoded once and kept; the ids are counted over the whole corpus; a
canonical Huffman code of limited length is made from the counts (a table of the vocabulary's size, made on the driver);
then every partition's documents are coded in independent blocks. A block is a row of a Parquet table: the documents'
ids and lengths, the packed bits, and the bit offset of every 256th id. Those checkpoints are lanes that decoding walks
side by side, each step one look-up of the next `limit` bits in a table.

The folder holds `code` (id, bits: the code lengths, from which the canonical code follows) and `blocks`. A null text is
an empty document: it has only the end id. Rows with a null id come first; equal ids are ordered by a hash of the text and
the text, so repeated rows are neighbours. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches, cut, shared_folder

LIMIT = 18
LANE = 256
BLOCK = 1 << 18
_BLOCKS = "part int, first long, start long, doc_ids array<long>, lengths array<long>, bits binary, offsets array<long>"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each id's code, 0 where it never occurs: the best code with no length over `limit` (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        merged = weights[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for is_leaf in reversed(levels):  # of the taken items at a level, the leaves are the lightest ones
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted to its own length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        own = lengths[order].astype(np.int64)
        span = np.uint64(1) << (int(own[-1]) - own).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(span[:-1], dtype=np.uint64)]).astype(np.uint64)
        codes[order] = at >> (int(own[-1]) - own).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes as bytes (first bit highest), and the bit offset of every LANE-th id."""
    own = lengths[ids].astype(np.int64)
    if not (own > 0).all():
        raise ValueError("an id has no code")
    at = np.cumsum(own) - own
    total = int(own.sum())
    word = at >> 5
    placed = codes[ids] << (64 - own - (at & 31)).astype(np.uint64)
    n = total // 32 + 2
    high = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::LANE]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every run of `width` bits: the id whose code begins it, times 32, plus the code's length."""
    width = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.zeros(1 << width, np.uint32)
    filled = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order], 1 << (width - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return table, width


def unpack(data: bytes, offsets: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """The n ids of a block."""
    out = np.zeros((len(offsets), LANE), np.uint32)
    padded = np.frombuffer(data + bytes(8 + LANE * 4), np.uint8)
    # 32 bits from every byte on: one gather a step
    quad = (padded[:-3].astype(np.uint32) << 24) | (padded[1:-2].astype(np.uint32) << 16) | (padded[2:-1].astype(np.uint32) << 8) | padded[3:]
    at, last = offsets.astype(np.int64).copy(), len(quad) - 1
    for step in range(min(LANE, n)):
        entry = table[((quad[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width))]
        out[:, step] = entry >> 5
        at += entry & 31
    return out.ravel()[:n]


def _encode(tokenizer: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.load(tokenizer)
        end = np.array([end_id], tokens.kind).tobytes()
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            coded = [x + end for x in tokens.encoded([x or "" for x in batch.column(1).to_pylist()])]
            sizes = np.array([len(x) for x in coded]) // np.dtype(tokens.kind).itemsize
            n = len(coded)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(start + np.cumsum(sizes) - sizes), batch.column(0), pa.array(sizes), pa.array(coded, pa.binary())], names=["part", "row", "start", "doc_id", "n_tokens", "ids"])
            row, start = row + n, start + int(sizes.sum())

    return work


def _tally(kind: str, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return work


def _pack(kind: str, lengths: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)

        def block(held):
            ids = np.concatenate([np.frombuffer(x[4].as_buffer(), kind) for x in held])
            bits, offsets = pack(ids, codes, lengths)
            first = held[0]
            return pa.RecordBatch.from_pylist([{"part": first[0], "first": first[1], "start": first[2], "doc_ids": [x[3] for x in held], "lengths": [len(x[4].as_buffer()) // np.dtype(kind).itemsize for x in held], "bits": bits, "offsets": offsets.tolist()}], schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("offsets", pa.list_(pa.int64()))]))

        held, size = [], 0
        for batch in batches:
            part, row, start, doc = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                if held and (size >= BLOCK or (part[i], row[i]) != (held[-1][0], held[-1][1] + 1)):
                    yield block(held)
                    held, size = [], 0
                held.append((part[i], row[i], start[i], doc[i], batch.column(4)[i]))
                size += len(held[-1][4].as_buffer()) // np.dtype(kind).itemsize
        if held:
            yield block(held)

    return work


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, limit: int = LIMIT) -> None:
    """Encode docs (doc_id, text), each with end_id after it, and write `code` and `blocks` under folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shape = bpe.load(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")  # ranges are drawn from sampled keys, which should not hold whole texts
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    encoded = cut(ordered.mapInArrow(_encode(tokenizer, end_id), "part int, row long, start long, doc_id long, n_tokens long, ids binary"))
    tally = encoded.select("ids").mapInArrow(_tally(shape.kind, shape.size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(shape.size, np.int64)
    for x in tally.collect():  # one row for each id of the vocabulary at most
        counts[x["id"]] = x["n"]
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{folder}/code")
    blocks = encoded.select("part", "row", "start", "doc_id", "ids").mapInArrow(_pack(shape.kind, lengths), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32 (of little-endian 32-bit ids); with_ids adds ids."""
    bounded_batches(spark)
    code = spark.read.parquet(f"{folder}/code").collect()  # as many rows as the vocabulary has ids at most
    lengths = np.zeros(max((x["id"] for x in code), default=0) + 1, np.uint8)
    for x in code:
        lengths[x["id"]] = x["bits"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, doc, n, bits, offsets = (batch.column(j)[i] for j in range(6))
                n = n.values.to_numpy()
                ids = unpack(bits.as_py(), offsets.values.to_numpy(), int(n.sum()), table, width).astype("<u4")
                ends = np.cumsum(n)
                each = [ids[e - k : e] for e, k in zip(ends, n)]
                out = [pa.array(np.full(len(n), part.as_py(), np.int32)), doc.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    found = blocks.select("part", "start", "doc_ids", "lengths", "bits", "offsets").mapInArrow(work, "part int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda t, x: t + x)).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the token file (in the shared folder unless one is named) and read it back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder)
