"""Token and entity metrics over BIO arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions.bio import LABELS, bio_spans
from railweave.functions.labels import safe_ratio


def token_pairs(df: DataFrame, true: str = "true_labels", pred: str = "pred_labels") -> DataFrame:
    """Aligned labels (y_true, y_pred, n), cut to the shorter array, counted map-side."""
    n = F.least(F.size(true), F.size(pred))
    zipped = F.arrays_zip(F.slice(true, F.lit(1), n).alias("t"), F.slice(pred, F.lit(1), n).alias("p"))
    return df.select(F.explode(zipped).alias("z")).groupBy(
        F.col("z.t").alias("y_true"), F.col("z.p").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def token_metrics(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per label, with the token accuracy beside it.

    The denominators are floored at 1 (counts) and 1e-9 (precision plus recall).
    """
    cls = F.explode(F.array(*map(F.lit, labels)))
    rows = token_pairs(df).select("*", cls.alias("label"))
    t, p = F.col("y_true") == F.col("label"), F.col("y_pred") == F.col("label")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counts = rows.groupBy("label").agg(
        total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"),
        (total(F.col("y_true") == F.col("y_pred")) / F.greatest(F.sum("n"), F.lit(1)))
        .alias("accuracy"))
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumns({
        "f1": 2 * F.col("precision") * F.col("recall") / F.greatest(
            F.col("precision") + F.col("recall"), F.lit(1e-9)),
        "support": F.col("tp") + F.col("fn")})


def token_confusion(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """True x predicted counts for the listed labels, zeros included."""
    counts = token_pairs(df).filter(F.col("y_true").isin(*labels) & F.col("y_pred").isin(*labels))
    wide = counts.groupBy("y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
    frame = df.sparkSession.createDataFrame([(v,) for v in labels], "y_true string")
    return frame.join(wide, "y_true", "left").na.fill(0, subset=list(labels))


def entity_metrics(df: DataFrame, true: str = "true_labels", pred: str = "pred_labels") -> DataFrame:
    """Span-exact precision, recall and F1 per type and over all ('micro').

    The two span lists of a row are compared as sets inside the row, so nothing but
    counts is shuffled.
    """
    t, p = bio_spans(F.col(true), strict_type=True), bio_spans(F.col(pred), strict_type=True)
    rows = df.select(t.alias("t"), p.alias("p"))
    flagged = F.concat(
        F.transform("t", lambda s: F.struct(
            s["type"].alias("type"), F.lit(1).alias("is_true"),
            F.array_contains("p", s).cast("int").alias("hit"), F.lit(0).alias("is_pred"))),
        F.transform("p", lambda s: F.struct(
            s["type"].alias("type"), F.lit(0).alias("is_true"),
            F.lit(0).alias("hit"), F.lit(1).alias("is_pred"))))
    per_type = rows.select(F.explode(flagged).alias("s")).groupBy("s.type").agg(
        F.sum("s.hit").alias("tp"), F.sum("s.is_true").alias("support"),
        F.sum("s.is_pred").alias("n_pred"))
    both = per_type.select(F.explode(F.array(F.col("type"), F.lit("micro"))).alias("type"),
                           "tp", "support", "n_pred").groupBy("type").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "n_pred")])
    return both.withColumns({
        "precision": safe_ratio(F.col("tp"), F.col("n_pred")),
        "recall": safe_ratio(F.col("tp"), F.col("support"))}).withColumn(
        "f1", safe_ratio(2 * F.col("precision") * F.col("recall"),
                         F.col("precision") + F.col("recall")))
