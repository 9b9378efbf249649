"""Phrases against plain counting and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from wayveil.llm import phrases, queries

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, most=3, top=2000, percent=50):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, most + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        holds = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    holds[p[i : i + m]] = max(holds[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if p in holds and 100 * holds[p] >= percent * a:
                continue
            score, _, le, ri = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), le, ri))
        out += [(lang, n + 1, p.decode(), -a, le, ri, total[lang], -score) for n, (score, a, p, le, ri) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "nord", "süd", "a", "b\x0bc", "x1", "\x00", "zz", "中", "\U0001f600", "é"]
    said = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for _ in range(rng.randrange(0, 60)))
    common = said() + "of the nord süd zz x1 a zz of the x1"
    return [(rng.choice(["en", "de", None]), rng.choice([said(), common, None, "", "the " * 500])) for _ in range(n)]


@pytest.mark.parametrize("case", [dict(), dict(least=3, most=4, top=20, percent=80), dict(least=2, most=2)])
def test_made_rows_equal_plain_code(spark, case):
    rows = made(4, 120)
    docs = spark.createDataFrame([(x, y, 1, "z") for x, y in rows], "lang string, text string, n int, phrase string").repartition(5)
    assert sorted(map(tuple, phrases.collocations(docs, **case).collect())) == plain(rows, **case)


@pytest.mark.parametrize("every", [1, 3, 1 << 40])
def test_the_parse_decides_nothing(spark, monkeypatch, every):
    monkeypatch.setattr(phrases, "_FLUSH", 200)
    rows = made(9, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, least=4, every=every).collect())) == plain(rows, least=4)


def test_copies_collapse_in_the_dictionary(spark):
    text = " ".join(random.Random(2).choice(["alpha", "beta", "gamma", "delta", "eta", "iota"]) for _ in range(400))
    one = phrases.dictionary(spark.createDataFrame([("en", text)], "lang string, text string"))
    many = phrases.dictionary(spark.createDataFrame([("en", f"intro{i} {text}") for i in range(50)], "lang string, text string"))
    assert many.count() <= one.count() + 51
    own = lambda d: d.selectExpr("sum(own * freq)").first()[0]  # noqa: E731  each word begins its phrases in one chunk
    assert own(one) == 400 and own(many) == 50 * 401


def test_scores_are_exact(spark):
    rng = random.Random(8)
    rows = [(a := rng.randrange(10, 10 ** rng.randrange(2, 15)), a + rng.randrange(10 ** rng.randrange(1, 14)), a + rng.randrange(3)) for _ in range(2000)] + [(10**14, 10**14, 10**14), (3, 9, 10**6)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in got)


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, "...")]])
def test_nothing_to_find(spark, rows):
    assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = queries.op12(spark, SF)
    want = con.sql(queries.PHRASES_SQL)
    assert got.columns == want.columns
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(want.fetchall()) and len(found) > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    assert found == plain(map(tuple, docs))
