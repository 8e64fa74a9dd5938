"""The ten queries on their whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_texts
from .exact import exact_dedup
from .hostrules import host_rules
from .packing import pack
from .quality import classify
from .simhash import near_dedup
from .substring import substring_dedup
from .suffix import suffix_dedup
from .urls import filter_urls
from .warc import archive_pages

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> tuple[str, str]:
    """Path and pre-splitting pattern of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(_table(spark, sf_dir, "pages"), with_payload=False)
    return read.selectExpr("row_id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"), with_ids=False)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_multi_50k.tiktoken")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_warc, op3_exact_dedup, op4_host_rules, op5_substring_dedup, op6_quality, op7_url_filter, op8_packing, op9_bpe, op10_suffix_dedup)
}
