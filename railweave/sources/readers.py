"""Scans (A1-A10, A18, A19).

Every reader has a fixed schema, so no pass over the data infers one.  A JSON array on a path that
all executors open is read in byte ranges (``json_array``); elsewhere such a file is one task, so ingest
it once (``ingest``) and read the Parquet copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions.labels import map_intent_label, map_language_label
from railweave.sources.json_array import array_paths, read_array

PASSENGER_STATIONS = (
    "nom string, libellecourt string, segment_drg string, "
    "position_geographique struct<lon: double, lat: double>, codeinsee string, codes_uic string")
STATION_LINES = (
    "code_uic string, libelle string, fret string, voyageurs string, code_ligne string, "
    "commune string, departemen string, x_wgs84 double, y_wgs84 double, "
    "c_geo struct<lon: double, lat: double>, pk string")
LINES = (
    "type_ligne string, code_ligne string, lib_ligne string, "
    "geo_shape struct<geometry: struct<coordinates: array<array<double>>>>")
TRIPS = (
    "date string, train_no string, origine string, destination string, origine_iata string, "
    "destination_iata string, heure_depart string, heure_arrivee string")
SAMPLES = (
    "sentence_id string, sentence string, intent string, language string, departure string, "
    "destination string, intermediate string")
REQUEST_LOG = (
    "timestamp string, input_text string, model_name string, duration_s double, "
    "cpu_percent_avg double, ram_peak_mb double, gpu_peak_mb double, carbon_kg double, "
    "output string, extra string")
INGEST_SALTS = 16
REPORT = "eval_type string, dataset string, samples bigint"


def _array_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON array file, or folder of such files, with ``ord``, the row order."""
    paths = array_paths(path)
    if paths:
        return read_array(spark, paths, schema)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn(
        "ord", F.monotonically_increasing_id())


def passenger_stations(spark: SparkSession, path: str) -> DataFrame:
    """A1."""
    return _array_file(spark, path, PASSENGER_STATIONS)


def station_lines(spark: SparkSession, path: str) -> DataFrame:
    """A2."""
    return _array_file(spark, path, STATION_LINES)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A3; ``network.line_attributes`` flips the coordinates."""
    return _array_file(spark, path, LINES)


def trips(spark: SparkSession, path: str) -> DataFrame:
    """A4."""
    return _array_file(spark, path, TRIPS)


def ingest(df: DataFrame, path: str, *partition_by: str) -> None:
    """Keep a splittable, columnar copy (A4: partitioned by ``date``)."""
    # the rows of one value go to a few tasks, not to one
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(INGEST_SALTS))
    writer = df.repartition(*partition_by, salt).write if partition_by else df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _first_of(df: DataFrame, names: list[str], default: str = "") -> Column:
    """The first of several column names that the file has."""
    present = [n for n in names if n in df.columns]
    return F.coalesce(F.col(f"`{present[0]}`"), F.lit("")) if present else F.lit(default)


def samples_csv(spark: SparkSession, path: str) -> DataFrame:
    """A5: 'text' or 'sentence', 'label' or 'intent', labels mapped.

    Only the header line is read to name the columns; all of them are strings.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option(
        "escape", '"').csv(path)
    return raw.select(
        _first_of(raw, ["text", "sentence"]).alias("sentence"),
        map_intent_label(_first_of(raw, ["label", "intent"])).alias("intent"),
        map_language_label(_first_of(raw, ["language"], "UNKNOWN")).alias("language"),
        *[_first_of(raw, [c]).alias(c) for c in ("departure", "destination", "intermediate")])


def samples_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """The language is mapped, the intent is taken as it is.

    One object or one array of objects per line, as ``write_json`` leaves them, which can be split over
    tasks; ``array_file`` reads documents that span lines, one task per file.
    """
    raw = spark.read.schema(SAMPLES).option("multiLine", array_file).json(path)
    return raw.withColumn("language", F.when(
        F.col("language").isNotNull(), map_language_label(F.col("language"))))


def utterances_csv(spark: SparkSession, path: str) -> DataFrame:
    """A7: 'sentenceID' or 'sentence_id', and 'sentence'."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(_first_of(raw, ["sentenceID", "sentence_id"]).alias("sentence_id"),
                      _first_of(raw, ["sentence"]).alias("sentence"))


def place_names_csv(spark: SparkSession, path: str) -> DataFrame:
    """City and station names, trimmed, without 'nan' and repeats."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    name = F.explode(F.array(F.trim("city_name"), F.trim("stations_name")))
    return raw.select(name.alias("name")).filter(
        (F.coalesce("name", F.lit("")) != "") & (F.lower("name") != "nan")).distinct()


def annotated_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_id, sentence, labels as an array); K8 turns them into roles."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(F.col("sentenceID").alias("sentence_id"), "sentence",
                      F.split(F.trim("labels"), r"\s+").alias("labels"))


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """A10: one JSON object per line; blank lines give no row."""
    return spark.read.schema(REQUEST_LOG).json(path).filter(F.col("timestamp").isNotNull())


def report_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(id, date, eval_type, dataset, samples), newest first.

    The id is the file name and the date its second '_' part.
    """
    raw = spark.read.schema(REPORT).option("multiLine", True).json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.json$", 1)
    listed = raw.withColumn("id", name).filter(F.col("id") != "")
    return listed.select(
        "id", F.coalesce(F.get(F.split("id", "_"), F.lit(1)), F.lit("unknown")).alias("date"),
        F.coalesce("eval_type", F.lit("all")).alias("eval_type"),
        F.coalesce("dataset", F.lit("test_set")).alias("dataset"),
        F.coalesce("samples", F.lit(0)).alias("samples")).orderBy(F.desc("id"))


def report(spark: SparkSession, folder: str, report_id: str) -> DataFrame:
    """The whole document of one report; no row when there is none."""
    whole = spark.read.option("wholetext", True).text(folder)
    # the file name is known before the file is read, so other reports are not opened
    return whole.filter(F.col("_metadata.file_name") == f"{report_id}.json").select(
        F.lit(report_id).alias("id"), F.col("value").alias("body"))
