"""Bounded samples of labelled documents and held-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm.frames import stored

PREFIX = 3  # hex digits of the drawing order that rows are counted by: 4,096 counts for each label


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y, the largest label of each id that has one."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).alias("y"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> dict[int, int]:
    """Rows of ``docs`` per value of ``label``: those that ``labelled_sample`` draws from."""
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).join(
        _known(labels, label).filter(allowed), "doc_id")
    return {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("_rows").alias("n")).collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_value: int,
                    columns: list[str]) -> DataFrame:
    """``columns`` and y of at most ``per_value`` documents for each value of ``label``.

    The sample is drawn on ids alone (smallest md5 first).  Its size is bounded, so it is broadcast and
    texts stay where they are.  Ids with several labels take the largest; null labels and ids are left out.

    Ids are counted by label and leading digits of the order first, and only those digits are ranked that
    the sample reaches into: a task sees the sample and one 4,096th of a label's ids, however many there are.
    """
    known = _known(labels, label).filter(allowed)
    drawn = F.md5(F.col("doc_id").cast("string"))
    here = stored(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "y", drawn.alias("drawn"), F.substring(drawn, 1, PREFIX).alias("head")), "labelled")
    before = F.sum("n").over(Window.partitionBy("y").orderBy("head")) - F.col("n")
    reached = here.groupBy("y", "head").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).filter(
        F.col("before") < per_value)
    order = Window.partitionBy("y").orderBy("drawn", "doc_id")
    taken = here.join(reached, ["y", "head"], "left_semi").withColumn(
        "_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_value)
    picked = F.broadcast(taken.select(F.col("doc_id").alias("_id"), "y"))
    return docs.join(picked, F.col("doc_id") == F.col("_id")).select(*columns, "y")
