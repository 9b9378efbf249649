"""Each stage of the pipeline on what its predecessor kept."""

import corpus_pipeline
from tests.llm.test_copies import brute_components, brute_leaks
from wayveil.llm import mixing


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((before, docs))
        if k < 4:
            assert docs.columns == names
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {r.doc_id for r in kept[0][1].collect()}
    assert len([i for i in labels if labels[i] == 1 and i in good]) >= 0.95 * sum(labels.values())
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in kept[1])
    assert {i for i, _ in after} == {c for _, _, c, _ in brute_components(before)}
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in kept[2])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in after} == {i for i, _ in before} - {d for d, _ in brute_leaks(before, items)}
    plan = {r.doc_id: r.repeats for r in mixing.mix(kept[3][0]).collect()}
    taken = [r.doc_id for r in kept[3][1].collect()]
    assert {i: taken.count(i) for i in plan} == plan
    rows = sorted(kept[4][1].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(taken) and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_stages_of_an_empty_table_and_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "", None, None, None), (None, None, "en", "s", 0), (7, "word " * 30_000, None, "s", 1), (7, "word " * 30_000, None, "t", 1)], docs.schema)
    for rows in (docs.where("false"), odd):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
            assert rows.count() >= 0, name
