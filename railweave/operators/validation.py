"""Dataset validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID_INTENTS = ["TRIP", "NOT_TRIP", "NOT_FRENCH", "UNKNOWN"]
REQUIRED_FIELDS = ["sentence_id", "sentence", "intent", "departure", "destination", "intermediate"]


def missing_fields(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """H4: required columns that the table lacks."""
    have = F.array(*map(F.lit, df.columns))
    lacking = F.explode(F.array_except(F.array(*map(F.lit, required)), have))
    return df.sparkSession.range(1).select(lacking.alias("field"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def row_rules(df: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, error): one row per violated rule."""
    intent, label = F.col("intent"), F.coalesce("intent", F.lit("None"))
    trip = F.coalesce(intent == "TRIP", F.lit(False))
    rules = [
        (~F.coalesce(intent.isin(VALID_INTENTS), F.lit(False)),
         F.concat(F.lit("Invalid intent '"), label, F.lit("'"))),
        (~F.coalesce(intent == "UNKNOWN", F.lit(False))
         & (F.trim(F.coalesce("sentence", F.lit(""))) == ""),
         F.lit("Empty sentence for non-UNKNOWN intent")),
        (trip & ~_filled("departure"), F.lit("TRIP missing departure")),
        (trip & ~_filled("destination"), F.lit("TRIP missing destination")),
        (F.coalesce(intent.isin("NOT_TRIP", "NOT_FRENCH", "UNKNOWN"), F.lit(False))
         & (_filled("departure") | _filled("destination")),
         F.concat(label, F.lit(" should not have departure/destination"))),
    ]
    found = F.filter(F.array(*[F.when(bad, message) for bad, message in rules]),
                     lambda m: m.isNotNull())
    return df.select(key, F.explode(found).alias("error"))


def unknown_stations(df: DataFrame, names: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, slot, value): slots of TRIP rows that name no known station.

    Distinct values are checked once, so a value in a third of the rows costs one lookup
    and its rows are only met again when it is unknown.
    """
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value"))
                                for s in ("departure", "destination", "intermediate")]))
    long = df.filter(F.col("intent") == "TRIP").select(key, slots.alias("s")).select(
        key, "s.*").filter(F.coalesce("value", F.lit("")) != "")
    unknown = long.select("value").distinct().join(
        names.select(F.col("name").alias("value")).distinct(), "value", "left_anti")
    return long.join(unknown, "value", "left_semi").select(key, "slot", "value")


def length_issues(df: DataFrame, key: str = "sentence_id", limit: int = 20) -> DataFrame:
    """The first issues of a report: too short (unless UNKNOWN) or too long."""
    n = F.length(F.coalesce("sentence", F.lit("")))
    short = (n < 3) & ~F.coalesce(F.col("intent") == "UNKNOWN", F.lit(False))
    found = F.filter(F.array(
        F.when(short, F.concat(F.lit("Very short sentence '"), "sentence", F.lit("'"))),
        F.when(n > 200, F.concat(F.lit("Very long sentence ("), n.cast("string"),
                                 F.lit(" chars)")))), lambda m: m.isNotNull())
    return df.select(key, F.explode(found).alias("issue")).orderBy(key, "issue").limit(limit)


def verdict(df: DataFrame, names: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Counts of rule and station errors and whether the set passes."""
    rules = row_rules(df, key).agg(F.count(F.lit(1)).alias("schema_errors"))
    stations = unknown_stations(df, names, key).agg(F.count(F.lit(1)).alias("station_errors"))
    # two one-row tables side by side
    return rules.join(stations).withColumn(
        "passed", F.col("schema_errors") + F.col("station_errors") == 0)
