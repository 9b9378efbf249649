"""MinHash near-duplicate detection with odd sketches.

Each document is reduced, in one pass without a shuffle, to its number of distinct five-word shingles, a 128-bit
fingerprint of the set, `bands` MinHash band values and an odd sketch: a bitmap in which every MinHash sample flips one
bit, so that the population count of the XOR of two sketches estimates a high similarity precisely.

1. Documents with equal sets are one node, named by the first row of the table of signatures that has the set.
2. In each band bucket every node is paired with one hub (a star, never all pairs); the hub's order changes over the bands,
   so a node of a large group meets a few hubs.
3. Pairs whose sizes or sketches rule the similarity out go; the rest are confirmed on full shingle sets of whole texts.
4. Buckets that still hold more than one component are cut into units of bounded size: nodes outside the bucket's largest
   component, `UNIT` at a time, against all its nodes, `UNIT` at a time. A task finds with the sketches which nodes of a
   unit have a partner in another component at all; those get their full sets and are compared in the task, the likeliest
   partner first, and two components that link there are one from then on. Each pair counts in the first band it shares.
   Components therefore equal those of all candidate pairs, while no row is ever made for a pair that is not a link.

With 32 bands of 4 rows a pair at similarity 0.75 is missed with probability 5e-6, at 0.8 with 5e-8. The sketch cuts lie
6.5 standard deviations below 0.75.

Nulls, empty texts and texts without words have an empty set and link with nothing. Rows with a null id link with
nothing and get a null component. Every row is a document of its own: exact repeats of a row get the same component, and
different texts under one id each have the component of their own text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Words, bounded_batches, cut, jaccard_at_least, marked, mix, scratch, slices

#: Nodes on each side of a unit of a bucket.
UNIT = 256
_U = np.uint64
_SIGNED = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
#: A node's number XOR one of these is its place in one of the orders that choose hubs.
_ORDERS = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x5851F42D4C957F2D)


def _fingerprint(own: np.ndarray) -> np.ndarray:
    """128 bits of a set of hashes."""
    return np.array([mix(own).sum(dtype=_U), mix(own ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)]).view(np.int64)


def signatures(docs: DataFrame, bands: int = 32, rows: int = 4, sketch_words: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, set_a and set_b (128 bits of the set), bands and sketch (arrays)."""
    bounded_batches(docs.sparkSession)
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, bands * rows, dtype=_U)[:, None] * _U(2) + _U(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=_U)[:, None]
    row_mult = rng.integers(1, 1 << 63, rows, dtype=_U) * _U(2) + _U(1)
    salt = np.arange(bands * rows, dtype=_U) * _U(0x9E3779B97F4A7C15)
    bits = 64 * sketch_words

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = Words(part.column(2)).shingles()
                n = part.num_rows
                count, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
                values, sketches = np.zeros((n, bands), np.int64), np.zeros((n, sketch_words), np.int64)
                for i in range(n):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    if not len(own):
                        continue
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, _U)
                    for k in range(0, len(own), 1024):
                        np.minimum(low, (own[k : k + 1024] * mult + plus).min(axis=1), out=low)
                    count[i], keys[i] = len(own), _fingerprint(own)
                    values[i] = mix((low.reshape(bands, rows) * row_mult).sum(axis=1, dtype=_U)).view(np.int64)
                    odd = (np.bincount((mix(low ^ salt) % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                    sketches[i] = np.packbits(odd).view(np.int64)
                nested = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count), pa.array(keys[:, 0]), pa.array(keys[:, 1]), nested(values), nested(sketches)], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return keyed(docs).mapInArrow(sign, _SIGNED)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the undirected edges (a, b). Label minima with pointer jumping."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("jumped"))
        labels = cut(lower.join(jump, "via", "left").select("node", "was", F.least("via", F.coalesce("jumped", "via")).alias("comp")))
        moved = labels.where("comp != was").limit(1).count()
        labels = labels.select("node", "comp")
        if not moved:
            return labels


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes, packed, of the wanted (doc_id, set_a, set_b, node)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = Words(part.column(0)).shingles()
                own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                keys = np.array([_fingerprint(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in own], pa.binary())], names=["set_a", "set_b", "shingles"])

    ids = wanted.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = marked(texts, F.col("doc_id"), ids).where("_hit").drop("_hit").join(ids, "doc_id", "left_semi")
    # An id may stand for other texts as well, and rows may repeat.
    packed = some.select("text").mapInArrow(pack, "set_a long, set_b long, shingles binary")
    return packed.join(wanted, ["set_a", "set_b"]).select("node", "shingles").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets reach the similarity. sets: (node, shingles)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [jaccard_at_least(np.frombuffer(left[i].as_buffer(), _U), np.frombuffer(right[i].as_buffer(), _U), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(test, "a long, b long")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int, most_bits: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow to reach the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    differing = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized & (differing <= most_bits)).select("a", "b")


def _most_bits(samples: int, bits: int, percent: int, deviations: float) -> int:
    """Bits in which the sketches of two sets at the similarity differ at most, but for a chance that many deviations out."""
    apart = 1 - percent / 100
    mismatches = min(float(samples), samples * apart + deviations * np.sqrt(samples * apart * (1 - apart)))
    return int(bits / 2 * (1 - np.exp(-4 * mismatches / bits))) + 10


def _units(held: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to units: band, value, i, j, node, comp, rest, query, target.

    rest: not in the bucket's largest component. A bucket of at most UNIT nodes is one unit, whose rows are both queries
    and targets; in a larger one each block of rest nodes meets each block of all nodes.
    """
    sizes = held.groupBy("band", "value", "comp").agg(F.count("*").alias("n"))
    mixed = cut(
        sizes.groupBy("band", "value")
        .agg(F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"))
        .where("comps > 1 and n > 2")
        .select("band", "value", F.col("main.comp").alias("main"), F.ceil(F.col("n") / UNIT).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("main.n")) / UNIT).cast("int").alias("rests"))
    )
    rows = held.join(mixed, ["band", "value"]).withColumn("rest", F.col("comp") != F.col("main"))
    block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    one = F.col("blocks") == 1
    across = lambda n: F.sequence(F.lit(0), F.when(one, 0).otherwise(F.col(n) - 1))
    cols = ["band", "value", "node", "comp", "rest"]
    target = rows.select(*cols, F.when(one, 0).otherwise(block(F.col("blocks"), 1)).alias("j"), F.explode(across("rests")).alias("i"), one.alias("query"), F.lit(True).alias("target"))
    query = rows.where(~one & F.col("rest")).select(*cols, F.explode(across("blocks")).alias("j"), block(F.col("rests"), 2).alias("i"), F.lit(True).alias("query"), F.lit(False).alias("target"))
    return target.unionByName(query)


def _each_unit(batches: Iterator[pa.RecordBatch], most: int = 1 << 26) -> Iterator[list[pa.Table]]:
    """Whole units, sorted by (band, value, i, j), several at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 4096 and sum(x.nbytes for x in held) < most:
            continue
        whole, rest = _split(pa.Table.from_batches(held), False)
        yield from whole
        held = rest.to_batches() if rest is not None else []
    if held:
        yield from _split(pa.Table.from_batches(held), True)[0]


def _split(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
    keys = np.stack([table[c].to_numpy() for c in ("band", "value", "i", "j")])
    edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
    upto = len(edges) - 1 if last else len(edges) - 2
    return [table.slice(edges[k], edges[k + 1] - edges[k]) for k in range(upto)], None if last else table.slice(edges[-2])


class _Unit:
    """The rows of a unit as arrays: which pairs (query, target) count, and how far apart their sketches are."""

    def __init__(self, rows: pa.Table, percent: int, most_bits: int):
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        own = lambda c: rows[c].to_numpy()
        self.node, self.comp = own("node"), own("comp")
        self.rest, size, self.bands, self.sketch, self.band = own("rest"), own("n_shingles"), flat("bands"), flat("sketch").view(_U), int(own("band")[0])
        self.size, self.percent, self.most_bits = size, percent, most_bits
        self.queries, self.targets = np.flatnonzero(own("query") & self.rest), np.flatnonzero(own("target"))

    def partners(self, q: int, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets of another component that sizes and sketches allow and that share no earlier band with q; nearest first."""
        t = self.targets[comp[self.targets] != comp[q]]
        t = t[100 * np.minimum(self.size[t], self.size[q]) >= self.percent * np.maximum(self.size[t], self.size[q])]
        t = t[np.argmax(self.bands[t] == self.bands[q], axis=1) == self.band]
        apart = np.bitwise_count(self.sketch[t] ^ self.sketch[q]).sum(axis=1)
        order = np.argsort(apart, kind="stable")
        order = order[apart[order] <= self.most_bits]
        # A pair of two rest nodes counts once, from the larger one.
        order = order[~self.rest[t[order]] | (self.node[t[order]] < self.node[q])] if len(order) else order
        return t[order], apart[order]


def _linked_units(percent: int, most_bits: int):
    """Of each unit, links between its components: few more than there are components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_unit(batches):
            unit, comp, found = (u := _Unit(rows, percent, most_bits)), u.comp.copy(), []
            held = [np.frombuffer(x.as_buffer(), _U) for x in rows["shingles"]]
            for q in unit.queries:
                t, step = unit.partners(q, comp)[0], 4
                while len(t):
                    some, t = t[:step], t[step:]
                    step = 128
                    tokens, ends = np.concatenate([held[k] for k in some]), np.cumsum([len(held[k]) for k in some])
                    at = np.minimum(np.searchsorted(held[q], tokens), len(held[q]) - 1)
                    both = np.add.reduceat((held[q][at] == tokens).astype(np.int64), np.concatenate([[0], ends[:-1]]))
                    for k in some[100 * both >= percent * (len(held[q]) + unit.size[some] - both)]:
                        if comp[k] != comp[q]:
                            found.append((unit.node[q], unit.node[k]))
                            comp[comp == comp[k]] = comp[q]
                    t = t[comp[t] != comp[q]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return work


def _hopeful(percent: int, most_bits: int):
    """The rows of each unit that have a partner in another component, by sizes and sketches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_unit(batches):
            unit = _Unit(rows, percent, most_bits)
            keep = np.zeros(rows.num_rows, bool)
            for q in unit.queries:
                t = unit.partners(q, unit.comp)[0]
                keep[t] = True
                keep[q] |= len(t) > 0
            yield from rows.filter(pa.array(keep)).to_batches()

    return work


_UNIT_ROW = "band int, value long, i int, j int, node long, comp long, rest boolean, query boolean, target boolean, n_shingles long, bands array<long>, sketch array<long>"


def _by_unit(rows: DataFrame) -> DataFrame:
    """Rows of a unit one after the other in one task."""
    return rows.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j")


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = 32, rows: int = 4, sketch_words: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for every row of docs (doc_id, text); see the module's text."""
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, percent, bands, rows, sketch_words))


def _near_duplicates(docs: DataFrame, percent: int, bands: int, rows: int, sketch_words: int) -> DataFrame:
    most_bits = _most_bits(bands * rows, 64 * sketch_words, percent, 6.5)
    signed = cut(signatures(docs, bands, rows, sketch_words).withColumn("row", F.monotonically_increasing_id()))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    named = cut(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("node")))
    nodes = cut(full.select(F.col("row").alias("node"), "n_shingles", "bands", "sketch").join(named.select("node"), "node"))

    buckets = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    # Four orders over the bands, so that a group's members do not all hang on one hub.
    order = F.element_at(F.array(*[F.lit(x).cast("long") for x in _ORDERS]), F.col("band") % 4 + 1)
    low = F.min(F.col("node").bitwiseXOR(order)).alias("low")
    hubs = cut(buckets.groupBy("band", "value").agg(low, F.count("*").alias("n")).where("n > 1").select("band", "value", F.col("low").bitwiseXOR(order).alias("hub")))
    stars = cut(buckets.join(hubs, ["band", "value"]).select("band", "value", "node", "hub"))
    pairs = stars.where("node != hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    first = cut(_plausible(pairs, nodes, percent, most_bits))

    sets = cut(sets_of(docs, named.join(first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).distinct(), "node", "left_semi")))
    links = cut(confirm(first, sets, percent))
    comps = components(links)

    # Buckets that the stars left with more than one component.
    held = cut(stars.select("band", "value", "node").join(comps, "node", "left").select("band", "value", "node", F.coalesce("comp", "node").alias("comp")))
    units = _units(held).join(nodes, "node").select(*[x.split()[0] for x in _UNIT_ROW.split(", ")])
    hopeful = cut(_by_unit(units).mapInArrow(_hopeful(percent, most_bits), _UNIT_ROW))
    missing = hopeful.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.union(cut(sets_of(docs, named.join(missing, "node", "left_semi"))))
    more = cut(_by_unit(hopeful.join(sets, "node")).mapInArrow(_linked_units(percent, most_bits), "a long, b long"))
    if more.limit(1).count():
        comps = components(links.union(more))

    # A component's id is its smallest document; nodes without a link are their own component.
    by_node = named.join(comps, "node", "left").select("set_a", "set_b", "doc_id", F.coalesce("comp", "node").alias("comp"))
    first_of = cut(by_node.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    ids = cut(by_node.join(first_of, "comp").select("set_a", "set_b", "component_id"))
    usable = F.expr("n_shingles > 0 and doc_id is not null")
    found = signed.where(usable).join(ids, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id", "text_key")
    alone = signed.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    return cut(found.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key"))


def without_copies(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all their columns, without near copies: of each component the row with its smallest id stays.

    Rows that repeat that id are copies too, unless no words make them alike: of equal texts under one id the row that is
    first by its other columns stays. Rows with a null id and rows without words all stay.
    """
    with scratch(docs.sparkSession) as keep:
        found = cut(near_duplicates(docs, **parameters).where("doc_id is not null and n_shingles > 0"))
        key = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).distinct()
        here = found.where("kept")
        # Of texts under one id in one component the smallest key stays, and of its rows the first.
        several = cut(here.groupBy("component_id").agg(F.count("*").alias("n"), F.min("text_key").alias("_stays")).where("n > 1"))
        others = key(here.join(several, "component_id").where("text_key != _stays"))
        lost = keep(cut(key(found.where("not kept")).union(others)))
        repeats = keep(cut(several.select(F.col("component_id").alias("_id"), F.col("_stays").alias("_text"))))
    # Rows whose id has lost no row stay where they are; the others meet what is lost.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = marked(row, F.col("row.doc_id").cast("long"), lost.select("_id").union(repeats.select("_id")))
    on = (F.col("row.doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_text"))
    left = row.where("_hit").join(lost, on, "left_anti")
    once = left.join(repeats, on, "left_anti")
    first = left.join(repeats, on).withColumn("place", F.row_number().over(W.partitionBy("_id", "_text").orderBy(F.to_json("row")))).where("place = 1")
    return row.where("not _hit").select("row.*").union(once.select("row.*")).union(first.select("row.*"))
