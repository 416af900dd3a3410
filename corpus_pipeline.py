"""From raw documents to sharded training data: five stages, each stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from railweave.llm.frames import fresh, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the bar; empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh(docs, "score")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels), score)
    return scored.filter(F.col(score) < toxicity.BAR).select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) is not in ``gone`` (doc_id, text_hash); nulls match."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")),
                     "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id; of repeated rows (doc_id and text) one stays, the
    one whose other columns have the smallest hash.

    Every row is judged by its own text, also where a doc_id is repeated.  Rows without doc_id and empty
    texts are in no group and stay.
    """
    left = _without(docs, near_duplicates.judged(docs).filter(~F.col("kept")))
    known, unknown = left.filter(F.col("doc_id").isNotNull()), left.filter(F.col("doc_id").isNull())
    row = F.struct(*docs.columns)
    first = known.groupBy("doc_id", "text").agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    return first.select("row.*").unionByName(unknown)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every row is judged by its own text, also without doc_id."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = decontamination.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=("doc_id", "text_hash"))
    return _without(docs, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: none, once or in several epochs."""
    rows = docs.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"),
                       F.md5("text").alias("tie"), F.struct(*docs.columns).alias("row"))
    taken = mixing.mix_sources(rows, tie=("tie",)).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with shard (0 to 7) and slot."""
    return sharding.interleave(docs, 8, tie=(F.xxhash64("text"),))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks),
          ("mixing", mix), ("sharding", shard)]

#: The models of the stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
