"""The queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm.centroids import centroid_clusters
from molquarry.llm.chat import chat_format
from molquarry.llm.common import table
from molquarry.llm.exact_dedup import exact_dedup
from molquarry.llm.hard_negatives import hard_negatives
from molquarry.llm.html_text import extracted
from molquarry.llm.mixing import mixed
from molquarry.llm.near_dedup import near_dedup
from molquarry.llm.oracles import ORACLES as ORACLES
from molquarry.llm.packing import pack
from molquarry.llm.quality import quality_rules
from molquarry.llm.secret_scan import secret_scan
from molquarry.llm.substring_dedup import substring_dedup
from molquarry.llm.suffix_dedup import suffix_dedup
from molquarry.llm.tokens import vocabulary
from molquarry.llm.urls import syndicated_keys, url_filter


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, syndicated_keys(pages))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The host's rate is a long fraction; its verdict is what the result needs.
    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op5_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), weights={"lang=en": 3.0, "domain=d1": 2.0})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixed_sources": op5_mixed_sources,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_near_dedup": op8_near_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_html_text": op12_html_text,
    "op13_hard_negatives": op13_hard_negatives,
}
