"""Language mixtures against plain code and held-out documents."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayveil.llm import languages, queries

SF = "/root/testdata/sf0.01"


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.99


def test_labels_of_held_out_documents_and_other_columns_decide_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    other = docs.copy()
    other.loc[[out(i) for i in other.doc_id], "lang"] = "xx"
    other["source"], other["bucket"] = "same", 5
    a, b = (sorted(map(tuple, languages.languages(spark.createDataFrame(x)).drop("mixture").collect())) for x in (docs, other))
    assert a == b


def words_of(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def test_words_and_ngrams_equal_plain_code():
    texts = ["Ab, cd! x", None, "", "12 .", "Straße\tÜber über", "a", "中文 ok"]
    for size in (2, 3, 4):
        got = languages.Letters(pa.array(texts), (size,), 1 << 30)
        want, per_word = [], []
        for text in texts:
            found = words_of(text or "")
            want.append(len(found))
            for w in found:
                raw = w.encode()
                marked = b" " + raw + b" " * size
                per_word.append(Counter(marked[i : i + size] for i in range(len(raw))))
        assert got.words.tolist() == want
        ends = np.append(got.first[1:], len(got.buckets[0]))
        kept = {}
        for a, b, grams in zip(got.first, ends, per_word):
            mine = Counter(got.buckets[0][a:b].tolist())
            assert sorted(mine.values()) == sorted(grams.values())
            # The same n-gram has the same bucket in every word.
            for gram in grams:
                kept.setdefault(gram, set()).update(mine)
            for gram in grams:
                kept[gram] &= set(mine)
        assert all(kept.values())


def plain_em(odds, allowed):
    share = np.where(allowed, 1 / sum(allowed), 0.0)
    for _ in range(3000):
        weight = odds * share
        share = (weight / weight.sum(axis=1, keepdims=True)).mean(axis=0)
    return share, np.log((odds * share).sum(axis=1)).sum()


def plain_choice(words, penalty):
    odds = np.exp(words - words.max(axis=1, keepdims=True))
    n, k = words.shape
    chosen = np.zeros(k, bool)
    chosen[np.log(odds).sum(axis=0).argmax()] = True
    share, likely = plain_em(odds, chosen)
    while not chosen.all():
        tried = []
        for j in np.flatnonzero(~chosen):
            wide = chosen.copy()
            wide[j] = True
            tried.append((plain_em(odds, wide), j))
        (new, found), j = max(tried, key=lambda x: x[0][1])
        if found - likely <= penalty * np.log(n + 1.0):
            break
        chosen[j], share, likely = True, new, found
    return chosen, share


def test_chosen_sets_and_proportions_equal_plain_em():
    rng = np.random.default_rng(3)
    docs = []
    for _ in range(60):
        n, mixture = int(rng.integers(1, 120)), rng.dirichlet([0.4] * 4)
        true = rng.choice(4, n, p=mixture)
        docs.append(rng.normal(0, 1.5, (n, 4)) + 2.5 * np.eye(4)[true] - 20)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])[:-1]
    got = languages.proportions(np.concatenate(docs), starts, 2.0, 1e-6)
    several = 0
    for row, words in zip(got, docs):
        chosen, share = plain_choice(words, 2.0)
        assert ((row > 0) == chosen).all() and np.abs(row - share).max() < 1e-2
        several += chosen.sum() > 1
    assert 10 < several < 60


def test_a_mixed_document_has_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.train(docs.select("lang", "text"))
    text = {r.lang: r.text for r in docs.where("length(text) between 900 and 1500").collect()}
    mixed = spark.createDataFrame([(1, f"{text['de'][:600]} {text['fr'][:600]}")], "doc_id long, text string")
    found = languages.predict(mixed, model).first()
    assert set(found.mixture) >= {"de", "fr"} and 0.3 < found.mixture["de"] < 0.7 and abs(sum(found.mixture.values()) - 1) < 0.01
    assert found.score == max(found.mixture.values()) and found.mixture[found.lang_pred] == found.score


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "en"), (2, "12 34 ...", "en"), (3, "the word", "en"), (3, "the word", "en"), (4, "das Wort " * 30_000, "de"), (None, "das", "de"), (5, "the", None)]
    docs = spark.createDataFrame([(i, t, x, "s") for i, t, x in rows], "doc_id long, text string, lang string, score string")
    got = languages.languages(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(1, "und"), (2, "und"), (None, "und"), (3, "en"), (4, "de"), (5, "en")} <= by
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got)
    assert all(r.held_out == out(r.doc_id) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "word", None)]])
def test_nothing_to_learn_from(spark, rows):
    got = languages.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_more_languages_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_NUMBERS", 2 << 16)
    docs = spark.createDataFrame([(i, "word", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        languages.train(docs)
