"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from geoloom.llm.decontaminate import leak_digest
from geoloom.llm.embedding_dedup import ORACLE as NEAR_VECTORS_ORACLE
from geoloom.llm.embedding_dedup import near_vectors
from geoloom.llm.hard_negatives import ORACLE as NEGATIVES_ORACLE
from geoloom.llm.hard_negatives import mine_negatives
from geoloom.llm.html_extract import extract_text
from geoloom.llm.line_dedup import line_digest
from geoloom.llm.packing import pack
from geoloom.llm.phrases import ORACLE as PHRASES_ORACLE
from geoloom.llm.phrases import collocations
from geoloom.llm.pii_scan import pii_digest
from geoloom.llm.quality import quality_digest
from geoloom.llm.secret_scan import secret_digest
from geoloom.llm.simhash import simhash_groups
from geoloom.llm.token_counts import count_tokens
from geoloom.llm.url_filter import ORACLE as URL_ORACLE
from geoloom.llm.url_filter import BLOCKLIST, judge_urls
from geoloom.sources.tables import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in BLOCKLIST], "url string")
    return judge_urls(table(spark, sf_dir, "pages"), listed)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_pii_scan": op8_pii_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_text": op10_html_text,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_phrases": op12_phrases,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": URL_ORACLE,
    "op11_embedding_dedup": NEAR_VECTORS_ORACLE,
    "op12_phrases": PHRASES_ORACLE,
    "op13_hard_negatives": NEGATIVES_ORACLE,
}
