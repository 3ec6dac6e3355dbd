"""The corpus pipeline: language, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as
Parquet and reads it back as the next stage's documents. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import bpe, decontaminate, langid, minhash, secret_scan
from noticelake.llm.common import DOCUMENT_COLUMNS, table, written
from noticelake.session import ship_package


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a text that is null or without letters goes. ``lang`` is filled in where it is null."""
    ship_package(spark)
    judged = langid.identify(docs.select(*DOCUMENT_COLUMNS)).where(F.col("lang_pred") != langid.UNKNOWN)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*DOCUMENT_COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id, null ones last; five-word shingles, similarity of 0.8 or more. Texts without words stay; rows alike in doc_id and text are one document."""
    ship_package(spark)
    return minhash.without_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_benchmark(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars brought up to date where a text changed."""
    ship_package(spark)
    masked = secret_scan.mask_secrets(docs.select(*DOCUMENT_COLUMNS))
    return masked.select(*DOCUMENT_COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of the ids and of the bytes that they decode to."""
    ship_package(spark)
    coded = bpe.encode_documents(docs)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_text),
    ("secrets", mask_secrets),
    ("tokens", encode_tokens),
]

#: Language models, MinHash components, structural secrets and BPE are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
