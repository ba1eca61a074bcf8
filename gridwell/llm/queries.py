"""The queries of this subpackage: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .embedding_dedup import embedding_groups
from .exact_dedup import exact_dedup
from .language_id import language_id, page_evidence
from .license_scan import license_scan, license_scan_sql
from .lm_score import lm_scores
from .ngram_join import ngram_jaccard_groups
from .packing import pack
from .quality import quality_scores
from .suffix_dedup import suffix_repeats


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), path=public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False).drop("ids", "width")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats(documents(spark, sf_dir), length=400, passage=300).drop("starts", "ends")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(documents(spark, sf_dir), n=3, num=90, den=100)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return language_id(pages, id_col="page_id", declared_col="declared", host_col="host", suffix_col="suffix")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() or k == "language_of_pages"}


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op1_license_scan": license_scan_sql(),
        "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, {lower} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256, strlen(norm)::BIGINT AS n_bytes
FROM t WINDOW g AS (PARTITION BY norm)""",
    }
