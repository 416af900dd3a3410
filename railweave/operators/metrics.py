"""Evaluation metrics over long prediction tables.

``pairs`` tables hold one row per sample and model: (model, y_true, y_pred, ...).  Every
metric is one grouped aggregate whose first half runs before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.functions.labels import (
    city_of_station, is_misspelled, normalize_location, safe_ratio, starts_lowercase,
)


def distribution(df: DataFrame) -> DataFrame:
    """Counts by intent, by language and by both, with their share of all rows, in one pass."""
    counted = df.groupingSets(
        [["intent"], ["language"], ["intent", "language"]], "intent", "language"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    # the intent level alone sums to the number of rows
    whole = F.sum(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy())
    return counted.select("intent", "language", "n", (F.lit(100.0) * F.col("n") / whole).alias("pct"))


def stop_share(df: DataFrame) -> DataFrame:
    """Share of TRIP rows with an intermediate stop."""
    trips = F.count_if(F.col("intent") == "TRIP")
    stops = F.count_if((F.col("intent") == "TRIP") & (F.coalesce("intermediate", F.lit("")) != ""))
    return df.agg(trips.alias("trips"), stops.alias("with_stop")).select(
        "trips", "with_stop", safe_ratio(F.col("with_stop"), F.col("trips")).alias("share"))


def length_profile(df: DataFrame) -> DataFrame:
    """One global aggregate."""
    sentence = F.coalesce("sentence", F.lit(""))
    lower_only = (F.lower(sentence) == sentence) & sentence.rlike(r"\p{L}")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(F.length(sentence)), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(F.length(sentence)), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.length(sentence)), F.lit(0)).alias("max_length"),
        F.count_if(lower_only & (F.col("intent") == "TRIP")).alias("lowercase_trips"),
        F.count_if(F.coalesce("intermediate", F.lit("")) != "").alias("with_intermediate"))


def duplicates(df: DataFrame, text: str = "sentence", limit: int = 10) -> DataFrame:
    """Texts seen more than once, most frequent first; the report shows ten.

    Only digests are shuffled; the texts of the few reported digests are looked up
    afterwards.  Equal counts are ordered by digest.
    """
    digest = F.sha2(text, 256)
    rows = df.filter(F.trim(text) != "")
    top = rows.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("n")).filter(
        "n > 1").orderBy(F.desc("n"), "_digest").limit(limit)
    return rows.select(digest.alias("_digest"), text).join(F.broadcast(top), "_digest").groupBy(
        text).agg(F.first("n").alias("n")).orderBy(F.desc("n"), F.sha2(text, 256))


def confusion_pairs(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y_true, y_pred, n): the small table that all label metrics start from."""
    return pairs.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def union_labels(pairs: DataFrame) -> DataFrame:
    """H3."""
    return pairs.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()


def class_counts(pairs: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest tp, fp, fn, tn for a given list of classes."""
    cls = F.explode(F.array(*map(F.lit, classes)))
    rows = confusion_pairs(pairs, keys).select(*keys, "y_true", "y_pred", "n", cls.alias("class"))
    t, p = F.col("y_true") == F.col("class"), F.col("y_pred") == F.col("class")
    t, p = F.coalesce(t, F.lit(False)), F.coalesce(p, F.lit(False))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return rows.groupBy(*keys, "class").agg(
        total(t & p).alias("tp"), total(~t & p).alias("fp"),
        total(t & ~p).alias("fn"), total(~t & ~p).alias("tn"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return counts.withColumns({"precision": precision, "recall": recall}).withColumns({
        "f1": safe_ratio(2 * F.col("precision") * F.col("recall"),
                         F.col("precision") + F.col("recall")),
        "support": tp + fn})


def macro_average(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Plain mean over the classes; an absent class counts as 0."""
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(f"macro_{c}")
                                        for c in ("precision", "recall", "f1")])


def weighted_average(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means weighted by support."""
    return metrics.groupBy(*keys).agg(*[
        safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
        for c in ("precision", "recall", "f1")])


def accuracy_by_language(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy overall (language 'ALL') and per language bucket, in one pass."""
    bucket = F.when(F.col("language").isin("FRENCH", "ENGLISH"), F.col("language")).otherwise("UNKNOWN")
    correct = F.coalesce(F.col("y_true") == F.col("y_pred"), F.lit(False))
    cells = pairs.groupBy(*keys, bucket.alias("language")).agg(
        F.count_if(correct).alias("correct"), F.count(F.lit(1)).alias("total"))
    both = F.explode(F.array(F.lit("ALL"), F.col("language")))
    return cells.select(*keys, both.alias("language"), "correct", "total").groupBy(
        *keys, "language").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")
                               ).withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total")))


def slot_outcome(predicted: Column, truth: Column) -> Column:
    """What one slot contributes to (tp, fp, fn, tn); both-absent counts as correct."""
    both = predicted.isNotNull() & truth.isNotNull()
    same = both & (predicted == truth)

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return F.struct(
        flag(same).alias("tp"),
        flag(predicted.isNotNull() & ~same).alias("fp"),
        flag(truth.isNotNull() & ~same).alias("fn"),
        flag(predicted.isNull() & truth.isNull()).alias("tn"))


def normalised_slots(samples: DataFrame, by_city: bool = False) -> DataFrame:
    """B15/B16 on the four slot columns; raw truths stay as true_*_raw."""
    tidy = city_of_station if by_city else normalize_location
    return samples.withColumns({
        **{f"true_{s}_raw": normalize_location(F.col(f"true_{s}")) for s in ("dep", "dest")},
        **{f"{side}_{s}": tidy(F.col(f"{side}_{s}")) for side in ("true", "pred")
           for s in ("dep", "dest")},
    })


def slot_metrics(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(slot, tp, fp, fn, tn) over samples(true_dep, pred_dep, true_dest, pred_dest)."""
    slots = F.explode(F.array(*[
        F.struct(F.lit(name).alias("slot"),
                 slot_outcome(F.col(f"pred_{short}"), F.col(f"true_{short}")).alias("o"))
        for name, short in (("departure", "dep"), ("destination", "dest"))]))
    return samples.select(*keys, slots.alias("s")).groupBy(*keys, F.col("s.slot").alias("slot")).agg(
        *[F.sum(f"s.o.{c}").alias(c) for c in ("tp", "fp", "fn", "tn")])


def both_slots_correct() -> Column:
    return F.col("pred_dep").eqNullSafe(F.col("true_dep")) & F.col("pred_dest").eqNullSafe(
        F.col("true_dest"))


def joint_accuracy(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both slots right, over all rows and over misspelled and lowercase sentences."""
    ok = both_slots_correct()
    odd = is_misspelled(F.col("sentence"), F.col("true_dep_raw"), F.col("true_dest_raw"))
    low = starts_lowercase(F.col("sentence"))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"),
        F.count_if(odd).alias("misspelling_total"), F.count_if(odd & ok).alias("misspelling_correct"),
        F.count_if(low).alias("lowercase_total"), F.count_if(low & ok).alias("lowercase_correct"),
    ).withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total")))


def model_grid(intents: DataFrame, slots: DataFrame) -> DataFrame:
    """Every classifier's prediction beside every extractor's, per sample.

    The join is on the sample; it multiplies a sample's rows by the number of models.
    """
    return intents.join(slots, "sample_id")


def combined_results(grid: DataFrame) -> DataFrame:
    """Intent accuracy on all rows, slot accuracy on TRIP rows, mean latency per pair."""
    trip = F.col("true_intent") == "TRIP"
    hit = F.coalesce(F.col("pred_intent") == F.col("true_intent"), F.lit(False))
    return grid.groupBy("intent_model", "slot_model").agg(
        F.count(F.lit(1)).alias("intent_total"), F.count_if(hit).alias("intent_correct"),
        F.count_if(trip).alias("slot_total"),
        F.count_if(trip & both_slots_correct()).alias("slot_correct"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    ).withColumns({
        "intent_accuracy": safe_ratio(F.col("intent_correct"), F.col("intent_total")),
        "slot_accuracy": safe_ratio(F.col("slot_correct"), F.col("slot_total"))})


def confusion_matrix(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per true label in the list, one column per predicted label; 0 where unseen."""
    counts = confusion_pairs(pairs, keys).filter(
        F.col("y_true").isin(*labels) & F.col("y_pred").isin(*labels))
    every = (counts.select(*keys).distinct() if keys else None)
    seed = pairs.sparkSession.createDataFrame([(v,) for v in labels], "y_true string")
    frame = seed if every is None else every.join(seed)
    wide = counts.groupBy(*keys, "y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
    return frame.join(wide, [*keys, "y_true"], "left").na.fill(0, subset=list(labels))


def normalise_matrix(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Each row as shares of its sum; an empty row stays 0."""
    total = sum((F.col(f"`{v}`") for v in labels), F.lit(0))
    return matrix.withColumns({v: safe_ratio(F.col(f"`{v}`"), total) for v in labels})


def mean_latency(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, and median from a sketch."""
    return predictions.groupBy(*keys).agg(
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.percentile_approx("latency_ms", 0.5).alias("p50_latency_ms"))


def run_delta(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("model",),
              value: str = "accuracy") -> DataFrame:
    """Metric of two runs side by side and their difference."""
    a = before.select(*keys, F.col(value).alias("before"))
    b = after.select(*keys, F.col(value).alias("after"))
    return a.join(b, list(keys)).withColumn("delta", F.col("after") - F.col("before"))


def rank_models(metrics: DataFrame, mine: str, value: str = "accuracy") -> DataFrame:
    """Best first, with the distance to one model (one row per model)."""
    own = metrics.filter(F.col("model") == mine).select(F.col(value).alias("own"))
    return metrics.join(own).select("model", value, (F.col(value) - F.col("own")).alias("delta")
                                    ).orderBy(F.desc(value), "model")


def best_model(metrics: DataFrame, keys: Sequence[str] = (), value: str = "accuracy") -> DataFrame:
    """The model of the highest value; ties go to the first name."""
    top = F.min(F.struct((-F.col(value)).alias("v"), "model"))
    return metrics.groupBy(*keys).agg(top.alias("b")).select(
        *keys, F.col("b.model").alias("model"), (-F.col("b.v")).alias(value))


def stage_impact(*deltas: tuple[str, DataFrame]) -> DataFrame:
    """Mean delta of each stage over models and tasks."""
    merged = None
    for stage, delta in deltas:
        part = delta.select(F.lit(stage).alias("stage"), "delta")
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy("stage").agg(F.avg("delta").alias("mean_delta"))
