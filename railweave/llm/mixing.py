"""Mixing sources to target weights (operator 10); DataFrame functions only.

Targets fill like water: sources share all words by weight, a source stops at three times its size, and
what it leaves is reshared by weight.  Rows get hash-random keys, are sorted by them within hash ranges of
their source, and prefix sums of word counts run inside the ranges on top of the sums of the ranges before.
Full epochs take every row; the rest of the budget is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm.frames import count_words, stored
from railweave.llm.sharding import hash_range, ranges_for, shuffle_key

SEED = 23
EPOCHS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn.  The table has one row per source of the
    mixture; its sort is the only step that is not split.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, len(weights)) + 1)
    capped = ranked.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = capped.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "before", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    ).withColumn("left", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    full = (F.col("cap").cast("decimal(19,0)") * F.col("left").cast("decimal(18,0)")
            <= F.col("weight").cast("decimal(18,0)") * (F.col("total") - F.col("before")).cast("decimal(19,0)"))
    level = (F.col("total") - F.col("before")).cast("double") / F.col("left").cast("double")
    leveled = wide.withColumn("full", full).withColumn(
        "level", F.max(F.when(~full, level)).over(everything))
    return leveled.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = SEED, tie: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text or size, source) with size, source_size, target, taken and copies.

    ``taken`` counts the words of the row in the mix, repeats included: all of it per full epoch, and what
    the rest of the source's budget reaches in hash order; at most one row per source is cut inside.
    ``copies`` counts whole rows instead: a row that begins inside the rest is taken whole.  No row exceeds
    ``EPOCHS`` times its size.  Null sources are one source, sorted last; null and empty texts have size 0
    and are taken 0 words.  The hash order covers doc_id and the columns ``tie``, so rows that share an id or
    have none keep one order if ``tie`` tells them apart (a digest of the text does).  An existing column of
    one of the new names is replaced.  No rows give no rows.
    """
    if "size" not in docs.columns:
        docs = docs.withColumn("size", count_words(F.col("text")))
    docs = docs.drop("source_size", "target", "taken", "copies")
    ranges = ranges_for(docs)
    # The row travels as one struct, so that no column of it meets a name used here.
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("source").alias("src"), F.col("size").alias("words"),
        F.struct(shuffle_key(seed, F.col("doc_id"), *[F.col(c) for c in tie]).alias("key"), "doc_id", *tie).alias("order")
    ).withColumn("part", hash_range(F.col("order.key"), ranges))
    sums = stored(keyed.groupBy("src", "part").agg(F.sum("words").alias("sum")), "mix-sums")
    before = Window.partitionBy("src").orderBy("part")
    starts = sums.select("src", "part", (F.sum("sum").over(before) - F.col("sum")).alias("start"))
    targets = source_targets(sums.groupBy(F.col("src").alias("source")).agg(F.sum("sum").alias("source_size")))
    starts = starts.join(targets, F.col("src").eqNullSafe(F.col("source"))).select(
        F.col("src").alias("of"), F.col("part").alias("at"), "start", "source_size", "target")
    inside = Window.partitionBy("src", "part").orderBy("order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = keyed.withColumn("local", F.sum("words").over(inside) - F.col("words"))
    joined = local.join(starts, F.col("src").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("local")
    return joined.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", rest).select(
        "row.*", "source_size", "target",
        (F.col("epochs") * F.col("words") + F.greatest(F.lit(0), F.least("rest", "words"))).cast("bigint").alias("taken"),
        (F.col("epochs") + (F.col("rest") > 0).cast("int")).cast("int").alias("copies"))
