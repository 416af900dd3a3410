"""Sinks (A11-A17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.functions.labels import extraction_line, route_line
from railweave.operators.gazetteer import POSTING_BLOCK, numbered_blocks, only_passenger
from railweave.operators.training import SAMPLE_COLUMNS


def append_log(requests: DataFrame, path: str) -> None:
    """Append requests as JSON lines; nulls are left out."""
    requests.write.mode("append").json(path)


def append_training_log(runs: DataFrame, path: str) -> None:
    """Training runs get the time of writing in UTC."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss'Z'")
    runs.withColumn("timestamp", stamp).write.mode("append").json(path)


def write_samples_csv(samples: DataFrame, path: str) -> None:
    """Header, fixed column order."""
    samples.select(*SAMPLE_COLUMNS).write.option("header", True).option("escape", '"').csv(path)


def write_json(records: DataFrame, path: str) -> None:
    """One JSON object per line, empty strings kept."""
    records.write.option("ignoreNullFields", False).json(path)


def route_lines(routes: DataFrame) -> DataFrame:
    """routes(id, path, error) to text lines."""
    return routes.select(route_line(F.col("id"), F.col("path"), F.col("error")).alias("value"))


def extraction_lines(results: DataFrame) -> DataFrame:
    """results(sentence_id, departure, destination, code) to (sentenceID, result)."""
    return results.select(F.col("sentence_id").alias("sentenceID"), extraction_line(
        F.col("sentence_id"), F.col("departure"), F.col("destination"), F.col("code"))
        .alias("result"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select(lines.columns[-1]).write.text(path)


def station_list(stations: DataFrame) -> DataFrame:
    """The passenger stations with their aliases (``gazetteer.with_aliases``)."""
    return only_passenger(stations).select(
        "name", F.col("name_norm").alias("normalized"), "short_code", "commune", "aliases")


def city_mapping(city_stations: DataFrame) -> DataFrame:
    """City -> station names, from (query, tier, ord, name) of ``stations_of_city``."""
    ordered = F.sort_array(F.collect_list(F.struct("tier", "ord", "name")))
    return city_stations.groupBy(F.col("query").alias("city")).agg(
        F.transform(ordered, lambda s: s["name"]).alias("stations"))


def city_blocks(city_stations: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """A16 in blocks: (city, block, n, stations) for cities of any size; blocks in turn give ``city_mapping``."""
    rows = city_stations.select(F.col("query").alias("city"), "tier", "ord", "name", "uic")
    part = F.sort_array(F.collect_list(F.struct("rn", "name")))
    return numbered_blocks(rows, "city", ["tier", "ord", "name", "uic"], block).groupBy("city", "block", "n").agg(
        F.transform(part, lambda s: s["name"]).alias("stations"))


def report_document(sections: dict[str, DataFrame], eval_type: str = "all",
                    dataset: str = "test_set", samples: int = 0) -> DataFrame:
    """One row with the nested report; each section is model -> metrics.

    The metric tables have one row per model (or pair of models) and stay long until
    this point.  A table with a 'model' column becomes a map, any other a list.
    """
    document = None
    for name, table in sections.items():
        metrics = F.struct(*[c for c in table.columns if c != "model"])
        body = (F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", metrics.alias("m")))))
                if "model" in table.columns else F.collect_list(metrics))
        part = table.agg(body.alias(name))
        document = part if document is None else document.join(part)
    return document.select(
        F.lit(eval_type).alias("eval_type"), F.lit(dataset).alias("dataset"),
        F.lit(samples).alias("samples"), *sections)


def write_report(document: DataFrame, path: str) -> None:
    """The document as JSON text."""
    document.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
