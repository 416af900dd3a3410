"""Proportional stratified interleaving (operator 1); DataFrame functions only.

Rows of a source are ranked in the order of a seeded hash, the fraction (rank - 1/2) / rows of the source
spreads every source evenly over [0, 1), and the sequence sorted by fraction is cut into shards of equal
counts, so each shard holds the mixture of the whole.  Ranks and positions come from counts per hash range:
about the square root of all rows per range, so neither a range nor the table of ranges outgrows a task,
and a source with a third of all rows is spread over all ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.llm.frames import fresh
from railweave.operators.scale import number_rows

SEED = 11


def ranges_for(df: DataFrame) -> int:
    """Number of hash ranges: the square root of the number of rows."""
    return max(1, math.isqrt(df.count()))


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A seeded hash as hex text; null parts count as empty."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def hash_range(key: Column, ranges: int) -> Column:
    """Number of the hash range, which rises with ``key``."""
    return F.floor(
        F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(4294967296.0))


def interleave(docs: DataFrame, shards: int, seed: int = SEED, tie: tuple[Column, ...] = ()) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in a shard).

    Counts of shards are at most one apart.  Null sources are one source of their own, null doc_ids one id;
    the hash order covers doc_id and ``tie``, which tells rows of one id apart and spreads them.  Existing columns shard and slot stay, and the new
    ones then get underscores in front.  No rows give no rows.
    """
    ranges = ranges_for(docs)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("src"), F.struct(
        shuffle_key(seed, F.col("doc_id"), *tie).alias("key"), "doc_id", *tie).alias("order"))
    ranked = number_rows(keyed, ["src"], [F.col("order")], hash_range(F.col("order.key"), ranges), "rank", "size")
    parted = ranked.withColumn("part", (2 * F.col("rank") - 1) / (2 * F.col("size"))).drop("order", "size")
    placed = number_rows(parted, [], [F.col("part"), F.col("src").asc_nulls_first(), F.col("rank")],
                         F.floor(F.col("part") * ranges), "place", "total")
    cut = placed.withColumn("shard", F.expr(f"CAST((place - 1) * {shards} div total AS INT)")).withColumn(
        "slot", F.expr(f"place - 1 - (shard * total + {shards - 1}) div {shards}"))
    return cut.select("row.*", F.col("shard").alias(fresh(docs, "shard")), F.col("slot").alias(fresh(docs, "slot")))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
