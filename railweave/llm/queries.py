"""Queries of the operators over the whole tables, with the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm import decontamination, fill_middle, language, license_scan, mixing, near_duplicates
from railweave.llm import quality_classifier, quality_rules, sharding, spelling, substrings, toxicity, url_filter
from railweave.llm.frames import stored
from railweave.llm.sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of equal counts and one mixture."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", sharding.text_size(F.col("text")).alias("size"),
        sharding.text_crc32(F.col("text")).alias("text_crc32"))
    return sharding.interleave(stored(docs, "sizes"), 8, tie=(F.col("text_crc32"), F.col("size"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page: the longest rule, else the regression."""
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules, url_filter.default_labels(spark)).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds of good quality of every document."""
    return quality_classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op4_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, four-word shingles at 80 %."""
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), shingle=4)


@query
def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the common words."""
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "common_words", "item_words", F.round("cosine", 4).alias("cosine"))


@query
def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document, with the verdict on its source."""
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).drop("host")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.language_id(read(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds that a document is toxic."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 20 words cover, and a digest of the rest."""
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"), texts=False).drop("kept_text")


@query
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.count_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    return mixing.mix_sources(stored(docs, "sizes"), tie=("digest",)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of the documents."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in the middle, and restored."""
    return fill_middle.fill_in_middle(read(spark, sf_dir, "documents"), texts=False).drop("output")


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
