"""One registered query for each training-data operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, chat, decontaminate, languages, mixing, near_dedup, phrases, quality, secrets, span_dedup, token_count, token_file, vectors
from .queries_path import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.secret_scan(_table(spark, sf_dir, "documents"))
    return found.drop("blob")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.span_dedup(_table(spark, sf_dir, "documents"), passage_words=51)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents")).withColumn("first_position", F.try_element_at("positions", F.lit(1)))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_position").orderBy("first_position", "doc_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat(_table(spark, sf_dir, "conversations"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    return alignment.aligned(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), digest).withColumnRenamed("groups", "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(_table(spark, sf_dir, "documents")).drop("mixture")


PHRASES_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs
), words AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, 1 AS m, unnest(w) AS phrase FROM words
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words
), f AS (
    SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL
), total AS (
    SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), cuts AS (
    SELECT lang, m, phrase, n AS a, split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND n >= 10
), parts AS (
    SELECT c.lang, c.m, c.phrase, a, k, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:k], ' ') AND x.m = k
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') AND y.m = c.m - k
), lowest AS (
    SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), holding AS (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM cuts WHERE m = 3 AND k = 1
), most AS (
    SELECT lang, phrase, max(a) AS longest FROM holding GROUP BY lang, phrase
), kept AS (
    SELECT o.* FROM lowest o LEFT JOIN most USING (lang, phrase) WHERE longest IS NULL OR o.m = 3 OR 100 * longest < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, total.n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_secret_scan": op1,
        "op2_token_counts": op2,
        "op3_token_file": op3,
        "op4_decontamination": op4,
        "op5_span_dedup": op5,
        "op6_near_dedup": op6,
        "op7_mixing": op7,
        "op8_quality": op8,
        "op9_near_vectors": op9,
        "op10_quotation_chat": op10,
        "op11_token_alignment": op11,
        "op12_phrases": op12,
        "op13_language_mixture": op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in {"op12_phrases": PHRASES_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
