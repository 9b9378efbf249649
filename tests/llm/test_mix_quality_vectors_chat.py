"""Mixing, quality, embeddings and chat against plain versions, properties and held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayveil.llm import chat, mixing, quality, vectors

SF = "/root/testdata/sf0.01"


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, most = {s: 1 + k % 3 for k, s in enumerate(names)}, {s: 3 * sizes[s] for s in names}
    stopped = set()
    while True:
        rest = sum(sizes.values()) - sum(most[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        out = {s: most[s] if s in stopped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in stopped and out[s] >= most[s]}
        if not over or over | stopped == set(names):
            return out | {s: most[s] for s in over}
        stopped |= over


def check_mix(docs):
    rows = {}
    for r in docs.collect():
        rows.setdefault(r.source, []).append((r.doc_id, len((r.text or "").encode().split())))
    sizes = {s: sum(n for _, n in x) for s, x in rows.items()}
    want, source = plain_targets(sizes), {i: s for s, x in rows.items() for i, _ in x}
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted(x for y in rows.values() for x in y)
    for s in sizes:
        own = [r for r in got if source[r.doc_id] == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], abs_tol=1e-6) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(n for _, n in rows[s])
        assert all(r.taken <= 3 * r.size and r.taken == r.size * r.repeats and len(r.positions) == r.repeats for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    return got


def test_mix_of_the_table(spark):
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"))


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 500, None), (5, "y\xa0z y", "é"), (6, "p q", ""), (7, "r", "zero"), (8, None, "none")] + [(k, "w " * k, "big") for k in range(10, 60)]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size int, place int")
    check_mix(docs)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed_documents(docs.where("false")).count() == 0
    twice = docs.union(docs).union(spark.createDataFrame([(None, "q r s", "s", 1, 1)], docs.schema))
    plan, out = mixing.mix(twice).collect(), mixing.mixed_documents(twice)
    assert out.columns == docs.columns and out.count() == sum(r.repeats for r in plan)
    assert sum(len((r.text or "").split()) for r in out.where("source = 'big'").collect()) == sum(r.taken for r in plan if r.doc_id and r.doc_id >= 10)


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, "a b c", "s", {"k": 1}), (1, "a b c", "t", {"k": 1}), (1, "a b c", "t", {"k": 2}), (1, "a b c", "t", {"k": 2}), (2, "d e f g", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row map<string,int>")
    plan, out = mixing.mix(docs).collect(), mixing.mixed_documents(docs).collect()
    assert len(out) == sum(r.repeats for r in plan)
    every = mixing.mixed_documents(docs, schedule=lambda sources: sources.withColumn("knots", F.expr("array(named_struct('t', 0D, 'w', double(source_size)), named_struct('t', 1D, 'w', double(source_size)))"))).collect()
    assert sorted(map(str, every)) == sorted(map(str, docs.collect()))  # weights by size: each row once


def test_a_schedule_of_zero_and_knots_at_one_time(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    none = "array(named_struct('t', 0D, 'w', 0D), named_struct('t', 1D, 'w', 0D))"
    jump = "array(named_struct('t', 0D, 'w', 1D), named_struct('t', 0.5D, 'w', 1D), named_struct('t', 0.5D, 'w', 3D), named_struct('t', 1D, 'w', 3D))"
    got = mixing.mix(docs, schedule=lambda x: x.withColumn("knots", F.expr(f"if(source_name = 'a', {none}, {jump})"))).collect()
    assert {(r.doc_id % 2, r.target) for r in got} == {(0, 0.0), (1, 400.0)}
    at = sorted(x for r in got for x in r.positions)
    assert len(at) == 40 and sum(x < 0.5 for x in at) == 10
    nobody = mixing.mix(docs, schedule=lambda x: x.withColumn("knots", F.expr(none))).collect()
    assert {(r.target, r.taken) for r in nobody} == {(0.0, 0)}


def test_positions_follow_the_schedule(spark):
    knots = [(0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 4.0)]
    t, w = np.array(knots).T
    fine = np.linspace(0, 1, 200_001)
    demand = np.concatenate([[0], np.cumsum((np.interp(fine[1:], t, w) + np.interp(fine[:-1], t, w)) / 2 * np.diff(fine))])
    df = spark.range(1, 100).select((F.col("id") / 100).alias("part"), F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("w")) for a, b in knots]).alias("knots"))
    for r in df.select("part", mixing.position(F.col("part"), F.col("knots"), F.lit(float(demand[-1]))).alias("at")).collect():
        assert abs(np.interp(r.at, fine, demand) - r.part * demand[-1]) < 1e-6


def plain_statistics(text):
    raw = (text or "").encode()
    words = [m[0] for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    n, per = max(len(raw), 1), max(len(words), 1)
    symbols = set(b"#$%&*@^~<>=+_\\/{}[]|")
    odd = [w[-1] in symbols for w in words]
    shouted = [sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in words]
    low = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in words]
    repeats = [k > 0 and low[k] == low[k - 1] for k in range(len(low))]
    recent = [any(k >= j and low[k] == low[k - j] for j in (1, 2, 3, 4)) for k in range(len(low))]

    def worst(flags):
        ends = [min(k + 32, len(flags)) for k in range(len(flags))]
        return max((sum(flags[max(e - 32, 0) : e]) / max(e - max(e - 32, 0), 1) for e in ends), default=0.0)

    share = lambda keep: sum(map(keep, raw)) / n
    return [
        math.log1p(len(words)), sum(map(len, words)) / per, share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in symbols), share(lambda c: c == 33), share(lambda c: c == 124), share(lambda c: c >= 128), share(lambda c: c == 10), share(lambda c: c in b".?"),
        *(sum(x) / per for x in (odd, shouted, repeats, recent)), len(set(low)) / len(words) if words else 0.0, *map(worst, (odd, shouted, repeats, recent)),
    ]


def test_statistics_and_rules_against_plain_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "A!  a| #"), (-4, "BIG big BIG big {x} " * 50)], docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rules = quality.fit(docs, labels)
    assert rules.weighted
    texts = {r.doc_id: r.text for r in docs.collect()}
    stats = {r.doc_id: r.stats for r in quality.with_statistics(docs, "stats", ["doc_id"]).collect()}
    for i, text in texts.items():
        assert np.allclose(stats[i], plain_statistics(text), atol=1e-9), i
    for r in quality.scored(docs, labels).collect():
        logit = rules.bias + sum(w for terms, w in rules.weighted if all((stats[r.doc_id][k] > t) == above for k, above, t in terms))
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), rel_tol=1e-9) and r.predicted == (r.score >= 0.5)


def test_other_labels_are_left_out(spark):
    docs = spark.createDataFrame([(k, f"word {k} " * (k + 1)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 7), (2, None), (3, -1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == quality.fit(docs, labels.where("quality in (0, 1)"))


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    accuracy = np.mean([(s >= 0.5) == (q == 1) for s, q in held])
    print("auc", auc, "accuracy", accuracy, "good kept", np.mean([s >= 0.5 for s in good]), "bad found", np.mean([s < 0.5 for s in bad]))
    assert auc > 0.97 and accuracy > 0.96


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a", 1), (3, "!!! ### " * 9, 1), (3, "x" * 99_999, 2)], "doc_id long, text string, stats int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert {r.predicted for r in quality.scored(docs, one).collect()} == {1}
    assert quality.good_documents(docs, one).columns == docs.columns
    assert quality.scored(docs.where("false"), one).count() == 0
    two = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.scored(docs, two).count() == 5


def test_paths_of_a_forest():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 > 2.0E-4)\n      Predict: 0.0\n     Else (feature 1 <= 2.0E-4)\n      Predict: 1.0\n    Else (feature 3 > 0.5)\n     Predict: 1.0\n"
    assert quality.paths(text) == [((3, False, 0.5),), ((1, True, 2e-4), (3, False, 0.5)), ((1, False, 2e-4), (3, False, 0.5)), ((3, True, 0.5),)]


def brute_vectors(rows, threshold=0.93):
    up = {i: i for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = {i: 0 for i, _, _ in rows}
    by = {}
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by.setdefault((label, len(v)), []).append((i, np.array(v, float) / np.linalg.norm(np.array(v, float))))
    for own in by.values():
        ids, m = [i for i, _ in own], np.stack([v for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = sorted((root(ids[a]), root(ids[b])))
            up[q] = p
    return {i: (links[i], root(i)) for i in links}


def test_vectors_of_the_table(spark):
    """The given table holds no link, so each of its vectors gets near ones, a few of them very many."""
    rng = np.random.default_rng(12)
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    top, more = max(i for i, _, _ in rows) + 1, []
    for k, (i, v, label) in enumerate(rows):
        for _ in range(150 if k in (3, 40) else k % 4):
            turn = rng.normal(size=len(v))
            more.append((top + len(more), v + rng.uniform(0.05, 0.5) * np.linalg.norm(v) * turn / np.linalg.norm(turn), label))
    rows = [(i, v.tolist(), label) for i, v, label in rows + more]
    want = brute_vectors(rows)
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    found, true = sum(x for x, _ in got.values()), sum(x for x, _ in want.values())
    assert got.keys() == want.keys() and true > 5000 and sum(x > 0 for x, _ in want.values()) > 0.5 * len(rows)
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * true
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_vectors_compared_exactly_where_tables_do_not_do(spark, monkeypatch):
    """An audit that nothing meets ends with all blocks compared, and gives what brute force gives."""
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(13)
    first = rng.normal(size=(120, 16))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(np.concatenate([first, first + 0.25 * rng.normal(size=first.shape), first[:30], first[:1] + 0.1 * rng.normal(size=(90, 16))]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = vectors.near_vectors(table, tables=1, target=1.5, most_tables=1).collect()
    want = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want and {r.audited_recall for r in out} == {1.0}
    assert sum(x > 0 for x, _ in want.values()) > 100


def test_a_copy_with_an_audited_id_is_audited(spark):
    """The node of ids 3 and 50 is audited for its copy's sake; block against block gives one share a node."""
    rows = [(3, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (8, [1.0, 0.02], 1), (100, [0.0, 1.0], 1)]
    nodes, named = vectors.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    node = {r.vec_id: r.node for r in named.collect()}
    recall = lambda links: vectors.audited_recall(nodes, named, spark.createDataFrame(links, "node long, links long"), 0.93)
    assert recall([(node[7], 3)]) == 0.0 and recall([(node[3], 1)]) == 0.5 and recall([(node[3], 2)]) == 1.0


def test_vectors_saturated_and_odd(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(k, (centre + 0.05 * rng.normal(size=16)).tolist(), 1) for k in range(300)] + [(1000 + k, rng.normal(size=16).tolist(), k % 3) for k in range(300)]
    rows += [(2000 + k, centre.tolist(), 1) for k in range(20)] + [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, centre.tolist(), None), (3004, [None] * 16, 1), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1)]
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    monkeypatch.setattr(vectors, "BLOCK", 100)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table).collect()}
    assert got == brute_vectors(rows)
    assert vectors.near_vectors(table.where("false")).count() == 0


def test_vectors_nested_groups(spark):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    centre = unit(rng.normal(size=64))
    versions = [centre + 0.2 * unit(rng.normal(size=64)) for _ in range(10)]
    rows = [v + 0.01 * unit(rng.normal(size=64)) for v in versions for _ in range(40)] + list(rng.normal(size=(300, 64)))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(rows)]
    want = brute_vectors(rows)
    assert sum(component == 0 for _, component in want.values()) == 400
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table).collect()} == want


def test_vectors_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre, first = unit(rng.normal(size=64)), unit(rng.normal(size=(400, 64)))
    rows = np.concatenate([centre + 0.1 * unit(rng.normal(size=(1500, 64))), first, first + 0.33 * unit(rng.normal(size=(400, 64))), rng.normal(size=(2700, 64))])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(rows)]
    want = brute_vectors(rows)
    assert sum(links > 0 for i, (links, _) in want.items() if i >= 1500) > 600
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = vectors.near_vectors(table).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert all(got[i][0] <= want[i][0] for i in want) and {r.audited_recall >= 0.97 for r in out} == {True}
    assert all(got[i] == want[i] for i in range(1500))
    assert sum(got[i] == want[i] for i in want if want[i][0] and i >= 1500) >= 0.95 * sum(x > 0 for i, (x, _) in want.items() if i >= 1500)


def test_vectors_go_on_until_the_audit_is_met(spark):
    """One table finds few of the lone pairs: their number is doubled as often as the audit asks for it."""
    rng = np.random.default_rng(10)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    first = unit(rng.normal(size=(1500, 32)))
    rows = np.concatenate([first, first + 0.36 * unit(rng.normal(size=(1500, 32)))])
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    want = brute_vectors([(k, v.tolist(), 1) for k, v in enumerate(rows)])
    out = vectors.near_vectors(table, tables=1).collect()
    found, true = sum(r.n_links for r in out), sum(x for x, _ in want.values())
    assert true > 1000 and 0.93 * true <= found <= true and out[0].audited_recall >= 0.97


def test_vectors_of_one_id(spark):
    near, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, near, 1), (5, far, 1), (7, [1.0, 0.01, 0.0], 1), (9, [0.01, 1.0, 0.0], 1), (5, near, 1)]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(5, 1, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 1, 5)]


def test_chat_links_quotes(spark):
    rows = [
        (1, 0, "user", "First question here?\n\nSecond paragraph."), (1, 1, "assistant", "An answer."), (1, 2, "user", "> Second  PARAGRAPH.\nI ask about that."),
        (1, 3, "assistant", "On Monday Ann wrote:\n>> First question here?\n> An answer.\nNested reply."), (1, 4, "user", "> never said\nUnknown quote."), (1, 5, "user", None),
        (2, 0, "user", "> An answer.\nOther conversation."), (2, None, None, "no turn"), (None, 0, "user", "x"), (None, 1, "user", "> x\ny"), (3, 0, "user", "same"), (3, 0, "user", "same"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {(r.conv_id, r.place): (r.parent, r.depth, r.n_quotes, r.by_quote, r.text) for r in chat.chat(table).collect()}
    assert len(got) == len(rows)
    assert got[1, 2] == (0, 1, 1, True, "I ask about that.")
    assert got[1, 3] == (1, 2, 2, True, "Nested reply.")
    assert got[1, 4] == (3, 3, 1, False, "Unknown quote.") and got[1, 5] == (4, 4, 0, False, "")
    assert got[2, 1] == (0, 1, 1, False, "Other conversation.") and got[None, 1] == (0, 1, 1, True, "y")
    assert chat.chat(table.where("false")).count() == 0


def test_chat_links_nested_quotes(spark):
    rows = [(1, 0, "a", "First."), (1, 1, "b", "Second."), (1, 2, "c", "> > First.\nNested only."), (1, 3, "a", "> unknown\n>>> First.\n>> Second.\nTwo."), (1, 4, "b", ">> Second.\n> First.\nLevel one.")]
    got = {r.place: (r.parent, r.by_quote) for r in chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, False), 1: (0, False), 2: (0, True), 3: (1, True), 4: (0, True)}


def test_bodies_keep_what_is_no_quote():
    code = "Try\n\n\n\n```\n> not a quote\n>>> print(1)\n```\n  done  "
    assert chat.parsed(code) == (code, [])
    session = "It says\n>>> print(1)\n... \n1\n\n>>> x\nso."
    assert chat.parsed(session) == (session, [])
    assert chat.parsed("On Monday he wrote:\nNo quote here > at all.") == ("On Monday he wrote:\nNo quote here > at all.", [])
    assert chat.parsed("a\n\n\n\nOn Monday he wrote:\n\n> b\n> c\n>> d\n>>> e\nf > g") == ("a\n\n\n\n\nf > g", [(1, "b\nc"), (2, "d"), (3, "e")])
    assert chat.parsed(">>> deep\n> near\n") == ("", [(3, "deep"), (1, "near")])
    long = "> line\n" * 200_000
    assert chat.parsed(long)[1] == [(1, "\n".join(["line"] * 200_000))]


def brute_parents(rows):
    """Parents by trying every earlier message for every quote."""
    flat = lambda x: " ".join(re.sub(r"(?m)^[ \t]*(?:>[ \t]?)+", "", x).lower().split())

    def pieces(x):
        found = [x, *re.split(r"\n[ \t]*\n", x), *x.split("\n")]
        return list(dict.fromkeys(y for y in map(flat, found) if y))

    out = {}
    for conv in {r[0] for r in rows}:
        own = [chat.parsed(r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        for k, (_, quotes) in enumerate(own):
            best = max(((-level, -p, j) for level, q in quotes for p, x in enumerate(pieces(q)) for j in range(k) if x in pieces(own[j][0])), default=None)
            out[conv, k] = best[2] if best else k - 1 if k else None
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_chat_against_brute_force(spark, monkeypatch, block):
    """The given conversations, their messages quoting earlier ones, and one long conversation with a very common line."""
    import random

    draw, rows = random.Random(3), []
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    before = {}
    for r in table:
        earlier, text = before.setdefault(r.conv_id, []), r.text or ""
        if earlier and draw.random() < 0.6:
            quoted = draw.choice(earlier)
            marks = ">" * draw.choice([1, 1, 2])
            text = "\n".join(f"{marks} {x}" for x in quoted.split("\n")[: draw.choice([1, 5])]) + "\n" + text
        earlier.append(r.text or "")
        rows.append((r.conv_id, r.turn, r.role, text))
    rows += [(-1, k, "user", f"thanks\nown {k}" + ("\n> thanks" if k % 3 == 0 else f"\n>> own {k // 2}" if k % 3 == 1 else "")) for k in range(200)]
    monkeypatch.setattr(chat, "BLOCK", block)
    got = {(r.conv_id, r.place): r.parent for r in chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = brute_parents(rows)
    assert got == want and sum(p != k - 1 for (_, k), p in want.items() if k) > 50


def test_chat_of_equal_and_null_turns(spark):
    rows = [(1, None, "user", f"text {k % 7}") for k in range(300)] + [(1, 5, "user", "> text 3\nyes")]
    out = chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.place for r in out) == list(range(301)) and next(r for r in out if r.turn == 5).place == 300
    assert next(r for r in out if r.turn == 5).parent == max(r.place for r in out if r.text == "text 3")


def test_chat_keeps_every_message(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = chat.chat(table)
    assert got.count() == table.count()
    assert got.where("depth != place or chat not like '<|im_start|>%<|im_end|>'").count() == 0


@pytest.mark.parametrize("n", [700])
def test_chat_long_conversation(spark, n):
    rows = [(1, k, "user", f"message {k}" + (f"\n> message {k - 300}" if k >= 300 else "")) for k in range(n)]
    got = {r.place: r.parent for r in chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {k: (k - 300 if k >= 300 else k - 1 if k else None) for k in range(n)}
