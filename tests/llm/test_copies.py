"""Near copies, repeated spans and benchmark leaks against brute force."""

import re
from collections import Counter

import pytest

from wayveil.llm import decontaminate, near_dedup, span_dedup

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, up = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * (both := len(x & y)) >= 75 * (len(x) + len(y) - both):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                up[q] = p
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def test_near_duplicates_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def chain(n):
    return [f"w{k}" for k in range(n)]


def test_near_duplicates_chain_and_odd_rows(spark):
    # Each text shares most of its words with the next one only: one component along the chain.
    rows = [(100 - k, " ".join(f"w{j}" for j in range(k * 10, k * 10 + 100))) for k in range(8)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO  words"), (6, "two words more"), (7, "x" * 100_000), (8, "a b c d e f"), (9, "A b\tc d e f")]
    docs = spark.createDataFrame([(i, t, 0, [1]) for i, t in rows], "doc_id long, text string, node int, bands array<int>")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(nulls).collect())
    assert got == {(None, None, True): 2, (3, 3, True): 2}


def test_cross_component_pairs(spark):
    # Two groups and a bridge in one bucket: small ids come first, so stars alone cannot join all of them.
    base = chain(400)
    rows = [(1, base)] + [(10 + k, base[: 100 + k] + ["q"] * 2 + base[102 + k :]) for k in range(40)]
    rows = [(i, " ".join(t)) for i, t in rows] + [(5, " ".join(base[60:])), (6, " ".join(base[110:] + chain(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (3, b), (3, b), (5, b + " more"), (7, a + " more"), (9, "alone here"), (9, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(3, 3, True): 3, (5, 3, False): 1, (7, 3, False): 1, (9, 9, True): 2}


def test_without_copies_keeps_one_row_of_a_component(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a, 1), (3, a, 2), (3, a + " more", 1), (3, b, 1), (5, a, 0), (5, "c d e f g h", 7), (1, b, 9), (None, a, 1), (None, a, 1), (8, None, 1), (8, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = near_dedup.without_copies(docs).collect()
    assert Counter((r.doc_id, (r.text or "")[:2]) for r in got) == {(3, "a0"): 1, (5, "c "): 1, (1, "b0"): 1, (None, "a0"): 2, (8, ""): 2}
    assert sorted(map(str, got)) == sorted(map(str, near_dedup.without_copies(docs.repartition(3)).collect()))
    assert near_dedup.without_copies(docs.where("false")).columns == docs.columns


def test_a_large_group_with_an_unlike_hub(spark, monkeypatch):
    """Near copies of which many are unlike the hubs of their buckets, over units of few nodes."""
    import random

    draw = random.Random(5)
    base = chain(120)
    rows = []
    for k in range(400):
        text, changed = list(base), draw.choice([0, 1, 2, 3, 4, 5, 6])
        for _ in range(changed):
            text[draw.randrange(120)] = draw.choice(["x", "y", f"own{k}"])
        rows.append((1000 - k, " ".join(text)))
    rows.append((1, " ".join(base[:70] + ["z"] * 50)))
    monkeypatch.setattr(near_dedup, "UNIT", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert len({c for _, _, c, _ in want}) > 3 and got == want


def brute_leaks(docs, items):
    out = {}
    grams = {}
    for i, t in items:
        w = words(t)
        g = min(5, len(w))
        if w:
            grams[i] = (len(w), g, Counter(tuple(w[k : k + g]) for k in range(len(w) - g + 1)))
    for d, t in docs:
        w = words(t)
        every = {tuple(w[k : k + g]) for g in {x[1] for x in grams.values()} for k in range(len(w) - g + 1)}
        for i, (n, g, own) in grams.items():
            if not every & own.keys():
                continue
            for k in range(max(1, len(w) - n + 1)):
                here = Counter(tuple(w[k + j : k + j + g]) for j in range(min(n, len(w) - k) - g + 1))
                value = sum((here & own).values()) / max(sum((here | own).values()), 1)
                if value >= 0.75:
                    out[d, i] = max(out.get((d, i), 0), value)
    return {k: round(v, 9) for k, v in out.items()}


@pytest.mark.parametrize("block_items", [2000, 15])
def test_leaks(spark, block_items):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "one two three"), (-4, "zero one two three four"), (-5, "x " * 60_000)], docs.schema)
    docs = docs.union(extra)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = items.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "one two three")], items.schema))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.benchmark_leaks(docs, items, block_items=block_items).collect()}
    want = brute_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert len(want) > 10 and got == want
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, items, block_items=block_items).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_look_up_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (300, 8)).astype(np.uint8)
    asks = prints[rng.integers(0, 300, 200)].copy()
    for k, row in enumerate(asks):
        for bit in rng.choice(64, k % 21, replace=False):
            row[bit // 8] ^= np.uint8(1 << (bit % 8))
    got = set(zip(*(x.tolist() for x in decontaminate._looked_up([decontaminate._table(prints[:, j]) for j in range(8)], asks, 300))))
    apart = np.bitwise_count(asks[:, None] ^ prints[None]).sum(axis=2)
    assert {(a, b) for a, b in zip(*np.nonzero(apart <= decontaminate.RADIUS))} <= got and len(got) < 200 * 300


def test_recall_of_the_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id * 50 AS doc_id", "text")
    found, every = decontaminate.measured_recall(docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))
    assert every > 10 and found >= 0.98 * every


def test_repeated_items_and_null_ids_of_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "z")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "b c d e f g"), (5, "q r s t u v")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontaminate.benchmark_leaks(docs, items).collect())
    assert got == {(1, 5, 1.0): 4, (1, None, 1.0): 2}


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.benchmark_leaks(docs, items).count() == 1
    assert decontaminate.benchmark_leaks(docs.where("false"), items).count() == 0
    assert decontaminate.benchmark_leaks(docs, items.where("false")).count() == 0
    assert decontaminate.clean_documents(docs, items.where("false")).count() == 1


def brute_spans(rows):
    """Sentences as lists of words with their bytes; runs by their words."""
    sentences = {}
    for i, t in rows:
        raw, out, cur = (t or "").encode(), [], []
        found = list(re.finditer(rb"[^\x20\x09-\x0d]+", raw))
        for k, m in enumerate(found):
            cur.append(m)
            if m[0][-1:] in (b".", b"!", b"?") or k + 1 == len(found) or b"\n" in raw[m.end() : found[k + 1].start()]:
                out.append(cur)
                cur = []
        sentences[i] = (raw, out)
    seen, gone = {}, {}
    for i in sorted(sentences):
        raw, s = sentences[i]
        for a in range(len(s)):
            b, n = a, 0
            while b < len(s) and (b - a < 2 or n < 16):
                n += len(s[b])
                b += 1
            if b - a >= 2 and n >= 16:
                key = tuple(m[0].lower() for x in s[a:b] for m in x)
                if key in seen:
                    gone.setdefault(i, set()).update(range(a, b))
                else:
                    seen[key] = (i, a)
    out = {}
    for i, lost in gone.items():
        raw, s = sentences[i]
        starts = [x[0].start() for x in s] + [len(raw)]
        text = raw[: starts[0]] + b"".join(raw[starts[k] : starts[k + 1]] for k in range(len(s)) if k not in lost)
        out[i] = (len(s), len(lost), text.decode())
    return out


def test_span_dedup(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_spans([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in span_dedup.span_dedup(docs).collect()}
    assert len(want) > 50 and got == want


def test_span_dedup_odd_rows(spark):
    long = " ".join(f"word{k} goes on and on." for k in range(10))
    rows = [(3, f"Start here. {long} End é."), (1, long), (2, None), (4, ""), (None, long), (5, "a b. " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, a int")
    got = {r.doc_id: (r.n_removed, r.text, r.first_docs) for r in span_dedup.span_dedup(docs).collect()}
    assert got[3] == (10, "Start here. End é.", [1]) and got[None] == (10, "", [1]) and 1 not in got and 2 not in got
    assert got[5][0] == 19_999
    assert span_dedup.span_dedup(docs.where("false")).count() == 0


def test_span_dedup_of_repeated_ids(spark):
    long = " ".join(f"word{k} goes on and on." for k in range(10))
    other = " ".join(f"thing{k} is not here at all." for k in range(12))
    rows = [(1, long), (2, "Too short."), (2, f"{other} {long}"), (2, f"{other} {long}"), (None, long), (None, "Short."), (None, other), (3, other)]
    out = span_dedup.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed) for r in out) == {(2, 10): 2, (3, 12): 1, (None, 10): 1, (None, 12): 1}


def test_passages_of_over_fifty_words_are_found(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    first, repeats = {}, set()
    for i in sorted(docs):
        for k in range(len(docs[i]) - 54):
            key = hash(tuple(docs[i][k : k + 55]))
            if first.setdefault(key, i) != i:
                repeats.add(i)
    got = {r.doc_id for r in span_dedup.span_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(repeats - got) <= 0.05 * len(repeats), (len(repeats), len(repeats - got), sorted(repeats - got)[:10])


def test_every_passage_of_over_fifty_words_is_found(spark):
    """Each 51 words that stood before, in an earlier text or place, lose a run of SEED words at least."""
    from wayveil.llm import queries

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    removed = {r.doc_id: r.removed for r in queries.op5(spark, "/root/testdata/sf0.01").collect()}
    seen, repeats, kept = set(), 0, []
    for i in sorted(docs):
        found = list(re.finditer(rb"[^\x20\x09-\x0d]+", docs[i]))
        lost = [0]
        for m in found:
            lost.append(lost[-1] + any(x.start <= m.start() < x.end for x in removed.get(i, [])))
        for k in range(len(found) - 50):
            key = hash(tuple(m[0].lower() for m in found[k : k + 51]))
            if key in seen:
                repeats += 1
                if lost[k + 51] - lost[k] < span_dedup.SEED:
                    kept.append((i, k))
            seen.add(key)
    assert repeats > 1000 and not kept, (repeats, len(kept), kept[:10])


def test_passages_without_whole_sentences(spark):
    passage = " ".join(f"item{k}," for k in range(51))
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(60 + k)) + f" {passage} " + " ".join(f"more{k}x{j}" for j in range(40))) for k in range(30)]
    rows += [(100, f"{passage} end"), (101, f"{passage} end"), (102, 'He said "it ends so." ' + passage)]
    got = {r.doc_id: r for r in span_dedup.span_dedup(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=51).collect()}
    assert got.keys() == {i for i, _ in rows} - {0}
    for i, text in rows[1:]:
        lost = b"".join(text.encode()[x.start : x.end] for x in got[i].removed).decode()
        assert len(lost.split()) >= span_dedup.SEED and not set(lost.split()) - {*passage.split(), "end"}
    assert got[101].text == "" and got[101].n_sentences == got[101].n_removed == 1
