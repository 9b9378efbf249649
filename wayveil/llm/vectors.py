"""Near-duplicate embeddings by NN-descent.

Equal vectors of one label are one node with a multiplicity; a part is a label and a length. Lists of the `k` nearest
nodes known are refined until no new link comes up:

1. First lists: in each of `tables` hash tables nodes with equal signs under random projections stand in one bucket,
   ordered along one more projection and cut into windows, so a bucket of any size is many windows. A window's nodes meet.
2. Descent: the partners of a node, in either direction, meet each other. A list is full when it holds k links; it needs
   no better ones, so groups of near-equal vectors make no further candidates. Edges over more than twice the threshold's
   angle are not kept: no link of a linked node lies beyond them.
3. Full lists are enlarged to all links of the node without a row for each: the components that hold full lists get their
   centroid and radius. Two of them, or one and itself, whose angle and radii bound every pair below the threshold's angle
   are linked throughout, and only counted; those that the bounds keep apart are done; the rest are compared block against
   block, handing on a count for each node. So links between groups whose lists hold only their own members are found.
4. Audit: the links of every node that has a row with an id divisible by 50 are counted against all nodes of its part, block
   against block. While the mean share found is under `target`, the number of tables is doubled and the descent goes on. Where
   `most_tables` tables do not reach it, all nodes of a part are compared, block against block, and the result is exact.

Links are pairs found with cosine >= threshold in double precision. Null, zero and non-finite vectors, and rows with a null
label or a null id, link with nothing; they are returned as their own component. Rows that repeat an id are vectors of
their own, whatever they hold. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .near_dedup import components
from .shared import bounded_batches, cut, scratch

log = logging.getLogger(__name__)
#: Rows of a window of a bucket; nodes of a block.
WINDOW, BLOCK = 256, 1024
_EDGE = "node long, other long, sim double"


def _matrix(column) -> np.ndarray:
    """Packed vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def nodes_of(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, part, first, n, unit) of usable distinct vectors, and (vec_id, node) of every row (node null: not usable).

    first: the smallest vec_id of the node's rows. unit: the vector at length 1, packed doubles.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    base = table.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some, F.lit(False))
    rows = cut(base.withColumn("usable", usable))
    good = rows.where("usable")
    distinct = cut(good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    parts = cut(distinct.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("nodes")).withColumn("part", F.monotonically_increasing_id()))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(5).to_pylist():
                v = np.array(x)
                v = v / np.abs(v).max()  # squares of very small or large numbers
                out.append((v / np.linalg.norm(v)).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(out, pa.binary())], names=["node", "part", "nodes", "first", "n", "unit"])

    keyed = distinct.withColumn("dim", F.size("vector")).join(parts, ["label", "dim"])
    nodes = cut(keyed.select("node", "part", "nodes", "first", "n", "vector").mapInArrow(unit, "node long, part long, nodes long, first long, n long, unit binary"))
    named = good.join(distinct.select("label", "vector", "node"), ["label", "vector"]).select("vec_id", "node")
    alone = rows.where("not usable").select("vec_id", F.lit(None).cast("long").alias("node"))
    return nodes, cut(named.union(alone))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Rows that follow each other with equal keys, `most` at a time."""
    held: list[pa.RecordBatch] = []

    def split(last: bool) -> tuple[list[pa.Table], list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held)
        values = np.stack([table[c].to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        if most:
            edges = [x for a, b in zip(edges, edges[1:]) for x in range(a, b, most)] + [table.num_rows]
        upto = len(edges) - 1 if last else len(edges) - 2
        return [table.slice(edges[k], edges[k + 1] - edges[k]) for k in range(upto)], [] if last else table.slice(edges[-2]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 2048:
                whole, held = split(False)
                yield from whole
    if held:
        yield from split(True)[0]


def _edges(node: list[np.ndarray], other: list[np.ndarray], sim: list[np.ndarray]) -> pa.RecordBatch:
    flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([flat(node, pa.int64()), flat(other, pa.int64()), flat(sim, pa.float64())], names=["node", "other", "sim"])


def first_edges(nodes: DataFrame, reach: float, k: int, tables: int, first_table: int = 0) -> DataFrame:
    """(node, other, sim): the k nearest within each window of each hash table, as far as they are within reach."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node, part, size, units = (batch.column(c) for c in range(4))
            lengths = pc.binary_length(units).to_numpy() // 8
            for dim in np.unique(lengths):
                own = pa.array(np.flatnonzero(lengths == dim))
                x = _matrix(units.take(own))
                bits = np.clip(np.ceil(np.log2(np.maximum(size.take(own).to_numpy() / 16, 1))), 1, 30).astype(int)
                for t in range(first_table, first_table + tables):
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng([int(dim), t]).standard_normal((int(dim), 31))
                    along = x @ planes[dim, t]
                    code = ((along[:, :30] > 0) & (np.arange(30) < bits[:, None])) @ (1 << np.arange(30))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t), pa.int32()), part.take(own), pa.array(code, pa.int64()), pa.array(along[:, 30]), node.take(own), units.take(own)], names=["tab", "part", "code", "along", "node", "unit"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["tab", "part", "code"], WINDOW):
            if rows.num_rows < 2:
                continue
            x, node = _matrix(rows["unit"]), rows["node"].to_numpy()
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(sim, best, axis=1)
            ok = value >= reach
            yield _edges([np.repeat(node, ok.sum(axis=1))], [node[best[ok]]], [value[ok]])

    signed = nodes.select("node", "part", "nodes", "unit").mapInArrow(signs, "tab int, part long, code long, along double, node long, unit binary")
    order = ["tab", "part", "code", "along", "node"]
    return signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(meet, _EDGE)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node's edges, each once."""
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _full(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node): lists that hold k links."""
    return lists.where(F.col("sim") >= threshold).groupBy("node").agg(F.count("*").alias("links")).where(F.col("links") >= k).select("node")


def descend(lists: DataFrame, nodes: DataFrame, threshold: float, reach: float, k: int) -> DataFrame:
    """The lists after all their neighbourhoods have met, again and again until no new link comes up."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["at"]):
            x, node, full = _matrix(rows["unit"]), rows["node"].to_numpy(), rows["full"].to_numpy(zero_copy_only=False)
            sim = x @ x.T
            a, b = np.nonzero((sim >= reach) & ~np.eye(len(x), dtype=bool) & ~full[:, None])
            yield _edges([node[a]], [node[b]], [sim[a, b]])

    turn = 0
    while True:
        turn += 1
        full = cut(_full(lists, threshold, k))
        back = lists.select(F.col("other").alias("at"), "node").withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy(F.xxhash64("node", F.lit(turn))))).where(F.col("rank") <= k).select("at", "node")
        hoods = cut(lists.select(F.col("node").alias("at"), F.col("other").alias("node")).union(back).distinct().join(full.withColumn("full", F.lit(True)), "node", "left").fillna(False, ["full"]))
        live = hoods.groupBy("at").agg(F.min("full").alias("done"), F.count("*").alias("members")).where("not done and members > 1").select("at")
        rows = hoods.join(live, "at").join(nodes.select("node", "unit"), "node").select("at", "node", "full", "unit")
        met = rows.repartition("at").sortWithinPartitions("at").mapInArrow(meet, _EDGE)
        known = lists.select("node", "other")
        after = cut(nearest(lists.union(met), k))
        new = after.where(F.col("sim") >= threshold).join(known, ["node", "other"], "left_anti").limit(1).count()
        lists = after
        if not new:
            return lists


def _dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows with their block and the number of blocks of their key."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return rows.join(cut(sizes), key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))


def groups_of(dense: DataFrame) -> DataFrame:
    """(comp, part, centre, radius, size) of (comp, part, node, n, unit)."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            comp, lengths = batch.column(0).to_numpy(), pc.binary_length(batch.column(2)).to_numpy()
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                names, of = np.unique(comp[own], return_inverse=True)
                sums = np.zeros((len(names), int(dim) // 8))
                np.add.at(sums, of, _matrix(batch.column(2).take(pa.array(own))))
                parts = np.zeros(len(names), np.int64)
                parts[of] = batch.column(1).to_numpy()[own]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts), _packed(sums)], names=["comp", "part", "unit"])

    def whole(rows: pa.Table) -> pa.Table:
        """Of the sums of a component, one a batch that held some of it: the direction of their sum."""
        x = _matrix(rows["unit"]).sum(axis=0)
        x = x / (np.linalg.norm(x) or 1.0)
        return pa.table({"comp": rows["comp"][:1], "part": rows["part"][:1], "centre": pa.chunked_array([_packed(x[None, :])])})

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = [float(np.arccos(np.clip(np.frombuffer(a.as_buffer(), np.float64) @ np.frombuffer(b.as_buffer(), np.float64), -1, 1))) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(angle, pa.float64()), batch.column(3)], names=["comp", "angle", "n"])

    centres = cut(dense.select("comp", "part", "unit").mapInArrow(total, "comp long, part long, unit binary").groupBy("comp").applyInArrow(whole, "comp long, part long, centre binary"))
    angles = dense.select("comp", "unit", "n").join(centres.select("comp", "centre"), "comp").select("comp", "unit", "centre", "n").mapInArrow(apart, "comp long, angle double, n long")
    return cut(centres.join(angles.groupBy("comp").agg(F.max("angle").alias("radius"), F.sum("n").alias("size")), "comp"))


def near_groups(groups: DataFrame, threshold: float) -> DataFrame:
    """(p, q, all, size_p, size_q), p <= q: groups of a part that may hold links between them; all: every pair is one.

    Centres are compared block against block, as few as there are groups with full lists.
    """
    limit, slack = float(np.arccos(threshold)), 1e-7

    def compare(rows: pa.Table) -> pa.Table:
        x, comp, radius, size, side = _matrix(rows["centre"]), *(rows[c].to_numpy() for c in ("node", "radius", "size", "side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        angle = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
        angle[comp[left][:, None] == comp[right][None, :]] = 0
        wide = radius[left][:, None] + radius[right][None, :]
        a, b = np.nonzero(angle <= limit + wide + slack)
        every = angle[a, b] + wide[a, b] <= limit - slack
        a, b = left[a], right[b]
        low, high = np.where(comp[a] <= comp[b], a, b), np.where(comp[a] <= comp[b], b, a)
        return pa.table({"p": comp[low], "q": comp[high], "all": every, "size_p": size[low], "size_q": size[high]})

    return _pairs_of_blocks(_dealt(groups.withColumnRenamed("comp", "node"), "part", BLOCK), "part").groupBy("part", "i", "j").applyInArrow(compare, "p long, q long, all boolean, size_p long, size_q long").distinct()


def _pairs_of_blocks(dealt: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of blocks that its own is in: adds i <= j and side (0: in i, 1: in j only)."""
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(*[c for c in dealt.columns], F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))


def links_between(pairs: DataFrame, dense: DataFrame, threshold: float) -> DataFrame:
    """(node, p, q, links): how many vectors of the other group of a pair, or of its own, each node is linked with.

    pairs: (p, q). The members of the two meet block against block.
    """

    def compare(rows: pa.Table) -> pa.Table:
        x, node, n, side = _matrix(rows["unit"]), *(rows[c].to_numpy() for c in ("node", "n", "side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        close = x[left] @ x[right].T >= threshold
        close[node[left][:, None] == node[right][None, :]] = False
        links, some = close @ n[right], close.any(axis=1)
        found = left[some]
        return pa.table({"node": node[found], "p": rows["p"].take(pa.array(found)), "q": rows["q"].take(pa.array(found)), "links": links[some]})

    both = pairs.select("p", "q").union(pairs.where("p != q").select(F.col("q").alias("p"), F.col("p").alias("q")))
    dealt = cut(_dealt(dense.select("comp", "node", "n", "unit"), "comp", BLOCK))
    counts = cut(dealt.select("comp", "blocks").distinct())
    count = lambda c: counts.select(F.col("comp").alias(c), F.col("blocks").alias(f"blocks_{c}"))
    sized = cut(both.join(count("p"), "p").join(count("q"), "q"))
    rows = lambda own, across: dealt.join(sized.withColumnRenamed(own, "comp"), "comp").withColumnRenamed("comp", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{across}") - 1)))
    asks = rows("p", "q").select("p", "q", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "node", "n", "unit")
    answers = rows("q", "p").select("p", "q", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "node", "n", "unit")
    return asks.union(answers).groupBy("p", "q", "i", "j").applyInArrow(compare, "node long, p long, q long, links long")


def linked(lists: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node, links, comp) of nodes with links: those of the lists, and all links of groups that hold full lists."""
    one_way = lists.where(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = cut(one_way.union(one_way.select("b", "a")).distinct())
    comps = components(links)
    full = comps.join(_full(lists, threshold, k), "node", "left_semi").select("comp").distinct()
    crowded = cut(comps.join(full, "comp", "left_semi"))
    few = links.join(crowded.select(F.col("node").alias("a")), "a", "left_anti").join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    few = few.join(comps, "node").select("node", "links", "comp")
    if not crowded.limit(1).count():
        return few

    dense = cut(crowded.join(nodes.select("node", "part", "n", "unit"), "node"))
    near = cut(near_groups(groups_of(dense), threshold))
    every = near.where("all")
    whole = every.select(F.col("p").alias("comp"), F.when(F.col("p") == F.col("q"), F.col("size_p")).otherwise(F.col("size_q")).alias("add")).union(every.where("p != q").select(F.col("q").alias("comp"), F.col("size_p").alias("add")))
    own = every.where("p = q").select(F.col("p").alias("comp"), F.lit(True).alias("itself"))
    counted = cut(links_between(near.where("not all"), dense, threshold))
    some = counted.groupBy("node").agg(F.sum("links").alias("some"))
    total = dense.select("node", "n", "comp").join(whole.groupBy("comp").agg(F.sum("add").alias("whole")), "comp", "left").join(own, "comp", "left").join(some, "node", "left")
    # What a group counts of itself holds the node's own copies, which nodes are counted with apart.
    held = F.coalesce("whole", F.lit(0)) - F.when(F.col("itself"), F.col("n")).otherwise(0) + F.coalesce("some", F.lit(0))
    merged = components(every.where("p != q").select(F.col("p").alias("a"), F.col("q").alias("b")).union(counted.where("p != q").select("p", "q").distinct()))
    named = total.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("over")), "comp", "left")
    return few.union(named.select("node", held.alias("links"), F.coalesce("over", "comp").alias("comp")))


def audited_recall(nodes: DataFrame, named: DataFrame, found: DataFrame, threshold: float) -> float:
    """The mean share of their links that the audited nodes have; 1 where none has any. found: (node, links)."""

    def count(rows: pa.Table) -> pa.Table:
        x, node, n, side = _matrix(rows["unit"]), *(rows[c].to_numpy() for c in ("node", "n", "side"))
        asks, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        close = x[asks] @ x[rest].T >= threshold
        close[node[asks][:, None] == node[rest][None, :]] = False
        return pa.table({"node": node[asks], "links": close @ n[rest]})

    asks = nodes.join(named.where("vec_id % 50 = 0").select("node").distinct(), "node").select("part", "node", "n", "unit")
    ways = {"asks": _dealt(asks, "part", BLOCK), "rest": _dealt(nodes.select("part", "node", "n", "unit"), "part", 4 * BLOCK)}
    ways = {k: cut(v) for k, v in ways.items()}
    sizes = {k: v.select("part", F.col("blocks").alias("across")).distinct() for k, v in ways.items()}
    over = F.explode(F.sequence(F.lit(0), F.col("across") - 1))
    cols = ["part", "i", "j", "side", "node", "n", "unit"]
    queries = ways["asks"].join(sizes["rest"], "part").withColumn("j", over).withColumn("i", F.col("block")).withColumn("side", F.lit(0))
    others = ways["rest"].join(sizes["asks"], "part").withColumn("i", over).withColumn("j", F.col("block")).withColumn("side", F.lit(1))
    true = queries.select(*cols).union(others.select(*cols)).groupBy("part", "i", "j").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("all_links")).where("all_links > 0")
    got = true.join(found.select("node", "links"), "node", "left").agg(F.avg(F.least(F.coalesce("links", F.lit(0)) / F.col("all_links"), F.lit(1.0)))).first()[0]
    return 1.0 if got is None else got


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of links connects, fewer than it has rows."""
    unseen, out = close.any(axis=1), []
    while unseen.any():
        front = np.flatnonzero(unseen)[:1]
        unseen[front] = False
        while len(front):
            new = np.flatnonzero(close[front].any(axis=0) & unseen)
            out += zip(front[close[front][:, new].argmax(axis=0)].tolist(), new.tolist())
            unseen[new], front = False, new
    return out


def exactly_linked(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links, comp) of nodes with links, each block of a part against each. A task hands on a count for each node and
    edges of a forest, fewer than its nodes, never its pairs."""

    def compare(rows: pa.Table) -> pa.Table:
        x, node, n, side = _matrix(rows["unit"]), *(rows[c].to_numpy() for c in ("node", "n", "side"))
        close = x @ x.T >= threshold
        np.fill_diagonal(close, False)
        if (side == 1).any():  # the blocks' own pairs belong to the tasks of one block
            close &= side[:, None] != side[None, :]
        links, some = close @ n, close.any(axis=1)
        tree = _forest(close)
        ends = np.array(tree, np.int64).reshape(-1, 2)
        kinds = [(node[some], node[some], links[some]), (node[ends[:, 0]], node[ends[:, 1]], np.zeros(len(ends), np.int64))]
        return pa.table({c: np.concatenate([k[i] for k in kinds]) for i, c in enumerate(("a", "b", "links"))})

    units = _pairs_of_blocks(_dealt(nodes.select("part", "node", "n", "unit"), "part", BLOCK), "part")
    found = cut(units.groupBy("part", "i", "j").applyInArrow(compare, "a long, b long, links long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return counts.join(components(found.where("a != b").select("a", "b")), "node").select("node", "links", "comp")


def near_vectors(table: DataFrame, threshold: float = 0.93, k: int = 10, tables: int = 10, target: float = 0.97, most_tables: int = 160) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for every row of table (vec_id, embedding, label)."""
    bounded_batches(table.sparkSession)
    with scratch(table.sparkSession) as keep:
        return keep(_near_vectors(table, threshold, k, tables, target, most_tables))


def _near_vectors(table: DataFrame, threshold: float, k: int, tables: int, target: float, most_tables: int) -> DataFrame:
    nodes, named = nodes_of(table)
    reach = float(np.cos(min(2 * np.arccos(threshold), np.pi)))
    lists, done = cut(nearest(first_edges(nodes, reach, k, tables), k)), tables
    while True:
        lists = descend(lists, nodes, threshold, reach, k)
        found = cut(linked(lists, nodes, threshold, k))
        recall = audited_recall(nodes, named, found, threshold)
        log.info("near_vectors: %d tables, audited recall %.4f", done, recall)
        if recall >= target:
            break
        if 2 * done > most_tables:
            found, recall = cut(exactly_linked(nodes, threshold)), 1.0
            break
        lists, done = cut(nearest(lists.union(first_edges(nodes, reach, k, done, done)), k)), 2 * done
    # A component's id is its smallest vec_id; copies of a node are linked with each other.
    by_node = cut(nodes.select("node", "first", "n").join(found, "node", "left").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")))
    ids = by_node.groupBy("comp").agg(F.min("first").alias("component_id"))
    out = named.join(by_node.join(ids, "comp").select("node", "n_links", "component_id"), "node", "left")
    return cut(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.lit(recall).alias("audited_recall")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
