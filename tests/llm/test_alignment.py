"""Token alignment against plain single-process code."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayveil.llm import alignment, queries
from wayveil.llm.queries_path import tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "<|endoftext|>a<s> </s><0x41><unk>"), (5, "it's  1234 \n\n x y 中文 \U0001f600 !!\t\x00z "), (6, "x" * 50_000), (7, "a▁b"),
    (None, "null id"), (12, "same words  here"), (12, "same words  here"), (13, "ﬁne café naïve   x y"), (14, "   three before, three after   "), (15, "the " * 20_000),
]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    of_a = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda x: a.encode(x, add_special_tokens=False).ids), b.encode, of_a, of_b


@functools.cache
def plain(rows):
    """What the contract says, document by document."""
    encode_a, encode_b, of_a, of_b = libraries()
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b, raw = [], [], (" " + (text or "")).encode()
        if text:
            a, b = encode_a(" " + text), encode_b(text)
            if b"".join(map(of_a, a)) != raw or b"".join(map(of_b, b)) != raw:
                a, b = [], []
        groups, links, i, j, at = [], [], 0, 0, 0
        ends = lambda ids, of: list(np.cumsum([len(of(x)) for x in ids]))
        ea, eb = ends(a, of_a), ends(b, of_b)
        for cut in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            for x in range(i, i2):
                for y in range(j, j2):
                    if max(ea[x - 1] if x else 0, eb[y - 1] if y else 0) < min(ea[x], eb[y]):
                        links.append((a[x], b[y]))
            i, j, at = i2, j2, cut
        counts.update(set(links))
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc_id, len(a), len(b), len(groups), links, said))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(i, na, nb, g, len(k), sum(counts[p] == best[p[0]] for p in k), sum(counts[p] for p in k), said) for i, na, nb, g, k, said in found]


@pytest.mark.parametrize("which", ["table", "odd"])
def test_documents_equal_plain_code(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else spark.createDataFrame([(i, t, "x", 3) for i, t in ODD], "doc_id long, text string, pairs string, batch int")
    want = plain(tuple((r.doc_id, r.text) for r in docs.collect()))
    got = [tuple(r) for r in alignment.aligned(docs, A, B).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in plain(tuple((r.doc_id, r.text) for r in docs))]
    got = queries.op11(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_many_batches_and_partitions_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    rng = random.Random(3)
    rows = tuple((i, " ".join(rng.choice(["the", "theanent", "ofth", "Grüße,", "x1", "  ", "zu"]) for _ in range(30))) for i in range(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, alignment.aligned(docs, A, B).collect())) == sorted(plain(rows))


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_words_encode_as_whole_texts():
    """Words that are encoded one by one give the ids of the whole text, also for odd white space and characters."""
    encode_a, encode_b, _, _ = libraries()
    a, b = alignment._load(A), alignment._load(B)
    rng = random.Random(5)
    chars = list("  aethnis.,'\n\t012éß") + [" ", "中", "\U0001f600", "▁", " ", "<s>", "<|endoftext|>", "  ", " the", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 40)))
        assert a.ids(" " + text).tolist() == encode_a(" " + text)
        if "▁" not in text:
            assert b.ids(" " + text).tolist() == encode_b(text)


def test_groups_by_pointer_jumping():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        cut = lambda: np.append(np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)) if n > 1 else np.zeros(0, int), n)
        a, b = cut(), cut()
        both = np.intersect1d(a, b)
        group_a, group_b, _ = alignment.labelled(a, b)
        assert (group_a == np.searchsorted(both, a)).all() and (group_b == np.searchsorted(both, b)).all()
