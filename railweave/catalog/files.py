"""Queries of the scans (sections A1-A4, A7-A9, A18, A19): tables written in the format of a source, read back."""

from __future__ import annotations

import os
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from railweave.catalog import query, table
from railweave.operators import network as N
from railweave.operators.scale import Stage
from railweave.sources import readers


FILE_ROWS = 200_000  # rows of one JSON array


def array_files(rows, key, spark, file_rows=FILE_ROWS):
    """``rows`` as JSON arrays of about ``file_rows`` rows, one to a file, each in the order of ``key``; their folder.

    Rows of one key share a file, so no task holds more than a few files, however many rows there are.
    """
    files = max(1, -(-rows.count() // file_rows))
    body = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    tasks = max(2 * files, int(spark.conf.get("spark.sql.shuffle.partitions"))) if files > 1 else 1
    dealt = rows.select(key, body.alias("body"), F.pmod(F.xxhash64(key), F.lit(files)).alias("part")).repartition(tasks, "part")
    same = Window.partitionBy("part")
    numbered = dealt.withColumns({"rn": F.row_number().over(same.orderBy(key)), "n": F.count(F.lit(1)).over(same)})
    text = F.concat(F.when(F.col("rn") == 1, "[").otherwise(""), "body", F.when(F.col("rn") == F.col("n"), "]").otherwise(","))
    folder = f"{Stage(spark, 'array').root}/files"
    numbered.select("part", text.alias("value")).write.partitionBy("part").text(folder)
    return folder


def csv_folder(rows, spark):
    folder = f"{Stage(spark, 'csv').root}/file"
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return folder


@query("passenger_file", """SELECT s_name AS nom, s_suppkey || ';' || (s_suppkey + 5000000) AS codes_uic, 42 + s_suppkey / 64::DOUBLE AS lat FROM supplier""")
def passenger_file(spark, sf):
    """A1: JSON arrays of stations, read in byte ranges."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k.alias("k"), F.col("s_name").alias("nom"), F.concat_ws(";", k, k + 5000000).alias("codes_uic"),
        F.struct((k / 128).alias("lon"), (42 + k / 64).alias("lat")).alias("position_geographique"))
    got = readers.passenger_stations(spark, array_files(rows, "k", spark))
    return got.select("nom", "codes_uic", F.col("position_geographique.lat").alias("lat"))


@query("station_line_file", """SELECT l_suppkey::VARCHAR AS code_uic, l_orderkey::VARCHAR AS code_ligne, l_linenumber || '+' || lpad((l_quantity * 10)::INT::VARCHAR, 3, '0') AS pk,
  'O' AS voyageurs FROM lineitem""")
def station_line_file(spark, sf):
    """A2: every line item as a row of the station-line files."""
    rows = table(spark, sf, "lineitem").select(
        F.monotonically_increasing_id().alias("key"), F.col("l_suppkey").cast("string").alias("code_uic"),
        F.col("l_orderkey").cast("string").alias("code_ligne"), F.lit("O").alias("voyageurs"),
        F.concat(F.col("l_linenumber"), F.lit("+"), F.lpad((F.col("l_quantity") * 10).cast("int").cast("string"), 3, "0")).alias("pk"))
    stored = Stage(spark, "rows").save(rows)  # the numbers are fixed once they are written
    return readers.station_lines(spark, array_files(stored, "key", spark)).select("code_uic", "code_ligne", "pk", "voyageurs")


@query("line_file", """SELECT o_orderkey::VARCHAR AS line, o_orderpriority = '1-URGENT' AS is_high_speed, 42 + o_orderkey % 64 / 64::DOUBLE AS first_lat,
  -(o_orderkey % 32) / 32::DOUBLE AS last_lon FROM orders""")
def line_file(spark, sf):
    """A3: lines with nested coordinates, flipped to latitude first."""
    k = F.col("o_orderkey")
    points = F.array(F.array(-(k % 16) / 16, 42 + k % 64 / 64), F.array(-(k % 32) / 32, 43 + k % 64 / 64))
    rows = table(spark, sf, "orders").select(
        k.alias("k"), k.cast("string").alias("code_ligne"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Ligne a grande vitesse").otherwise("Ligne").alias("lib_ligne"),
        F.struct(F.struct(points.alias("coordinates")).alias("geometry")).alias("geo_shape"))
    got = N.line_attributes(readers.lines(spark, array_files(rows, "k", spark)))
    return got.select("line", "is_high_speed", F.col("geometry")[0][0].alias("first_lat"), F.col("geometry")[1][1].alias("last_lon"))


@query("trip_file", """WITH d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date FROM events)
SELECT date, event_id::VARCHAR AS train_no, event_type AS origine FROM d WHERE date = (SELECT max(date) FROM d)""")
def trip_file(spark, sf):
    """A4: the schedule is kept partitioned by date, and one day is read from its folder alone."""
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("k"), day.alias("date"), F.col("event_id").cast("string").alias("train_no"),
        F.col("event_type").alias("origine"))
    folder = f"{Stage(spark, 'trips').root}/days"
    readers.ingest(readers.trips(spark, array_files(rows, "k", spark)), folder, "date")
    last = rows.agg(F.max("date")).first()[0]
    kept = spark.read.option("basePath", folder).schema(readers.TRIPS).parquet(folder)
    return kept.filter(F.col("date") == last).select("date", "train_no", "origine")


@query("utterance_file", "SELECT conv_id || '-' || turn AS sentence_id, md5(text) AS sentence FROM conversations WHERE text <> ''")
def utterance_file(spark, sf):
    """Turns as a CSV file of utterances, line breaks and quotes included."""
    rows = table(spark, sf, "conversations").filter("text <> ''").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sentenceID"),
        F.regexp_replace("text", "\n", "\\\\n").alias("sentence"))
    got = readers.utterances_csv(spark, csv_folder(rows, spark))
    return got.select("sentence_id", F.md5(F.regexp_replace("sentence", r"\\n", "\n")).alias("sentence"))


@query("place_name_file", """SELECT DISTINCT trim(unnest([p_name, p_brand])) AS name FROM part""")
def place_name_file(spark, sf):
    """Names of two columns, trimmed, without 'nan' and repeats."""
    rows = table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("city_name"),
        F.when(F.col("p_partkey") % 7 == 0, "NaN").otherwise(F.col("p_brand")).alias("stations_name"))
    more = table(spark, sf, "part").select(F.lit("").alias("city_name"), F.col("p_brand").alias("stations_name"))
    return readers.place_names_csv(spark, csv_folder(rows.unionAll(more), spark))


@query("annotated_file", r"""SELECT item_id::VARCHAR AS sentence_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_labels,
  CASE WHEN item_id % 2 = 0 THEN 'B-LOC' ELSE 'O' END AS first_label FROM benchmark""")
def annotated_file(spark, sf):
    """Sentences with one label per word."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    label = F.when(F.col("item_id") % 2 == 0, "B-LOC").otherwise("O")
    rows = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("sentenceID"), F.array_join(words, " ").alias("sentence"),
        F.array_join(F.transform(words, lambda w, i: F.when(i == 0, label).otherwise("O")), " ").alias("labels"))
    got = readers.annotated_csv(spark, csv_folder(rows, spark))
    return got.select("sentence_id", F.size("labels").alias("n_labels"), F.element_at("labels", 1).alias("first_label"))


def reports(spark, sf):
    """One report file per nation: its customers as samples; the folder."""
    folder = f"{Stage(spark, 'reports').root}/files"
    local = re.sub("^file:(//)?", "", folder)
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("samples"))
    number = F.lpad((F.col("k") + 1).cast("string"), 2, "0")
    rows = n.select(F.concat(F.lit("evaluation_2024-01-"), number, F.lit("_00-00-"), number).alias("name"),
                    F.to_json(F.struct("samples", F.when(F.col("k") % 2 == 0, "intent").alias("eval_type"))).alias("body"))

    def write(frames):
        for frame in frames:
            os.makedirs(local, exist_ok=True)
            for name, body in zip(frame["name"], frame["body"]):
                with open(f"{local}/{name}.json", "w", encoding="utf-8") as file:
                    file.write(body)
            yield frame[["name"]]

    rows.mapInPandas(write, "name string").count()
    return folder


REPORTS = """r AS (SELECT c_nationkey AS k, count(*) AS samples, lpad((c_nationkey + 1)::VARCHAR, 2, '0') AS nn FROM customer GROUP BY 1),
f AS (SELECT *, 'evaluation_2024-01-' || nn || '_00-00-' || nn AS id FROM r)"""


@query("report_list", f"""WITH {REPORTS} SELECT id, '2024-01-' || nn AS date, CASE WHEN k % 2 = 0 THEN 'intent' ELSE 'all' END AS eval_type, 'test_set' AS dataset, samples FROM f""")
def report_list(spark, sf):
    """The catalogue of a folder of reports."""
    return readers.report_catalogue(spark, reports(spark, sf))


@query("report_by_id", f"""WITH {REPORTS} SELECT id, '{{"samples":' || samples || CASE WHEN k % 2 = 0 THEN ',"eval_type":"intent"' ELSE '' END || '}}' AS body FROM f WHERE k IN (7, 8)""")
def report_by_id(spark, sf):
    """Two reports by their ids; the other files are not opened."""
    folder = reports(spark, sf)
    return readers.report(spark, folder, "evaluation_2024-01-08_00-00-08").unionAll(
        readers.report(spark, folder, "evaluation_2024-01-09_00-00-09"))
