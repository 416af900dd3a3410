"""The test tables in the roles of the job inputs.

Documents are utterances, parts and suppliers are places and stations, line items are
stops of lines (one line per order), orders are lines, events are requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.operators.network import (
    both_directions, build_edges, build_nodes, hub_transfers, line_attributes, line_stops,
)
from railweave.operators.scale import padded, spread
from railweave.operators.training import (
    indexed, fill_slots, planned_rows, quota_plan, sequence_id, template_table,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitude(key: Column) -> Column:
    return F.lit(42.0) + F.pmod(key * 37, F.lit(900)) / 100


def longitude(key: Column) -> Column:
    return F.lit(-4.0) + F.pmod(key * 53, F.lit(1200)) / 100


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passenger-station source: one row per supplier."""
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("nom"), padded(key, 4, "S").alias("libellecourt"),
        F.lit("A").alias("segment_drg"),
        F.struct(longitude(key).alias("lon"), latitude(key).alias("lat")).alias("position_geographique"),
        F.col("s_nationkey").cast("string").alias("codeinsee"), key.cast("string").alias("codes_uic"),
        key.alias("ord"))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-line source: one row per line item; every seventh supplier also takes freight."""
    li = spread(read(spark, sf_dir, "lineitem"))
    key = F.col("l_suppkey")
    post = F.concat(F.col("l_linenumber").cast("string"), F.lit("+"),
                    padded((F.col("l_quantity") * 10).cast("int"), 3))
    return li.select(
        key.cast("string").alias("code_uic"),
        F.concat(F.lit("Stop "), key.cast("string")).alias("libelle"),
        F.when(F.col("l_returnflag") == "A", "O").otherwise("N").alias("fret"),
        F.when(F.col("l_linestatus").isin("F", "O"), "O").otherwise("N").alias("voyageurs"),
        F.col("l_orderkey").cast("string").alias("code_ligne"),
        F.concat(F.lit("Commune "), F.pmod(key, F.lit(17)).cast("string")).alias("commune"),
        F.concat(F.lit("Dept "), F.pmod(key, F.lit(5)).cast("string")).alias("departemen"),
        longitude(key).alias("x_wgs84"), latitude(key).alias("y_wgs84"),
        F.lit(None).cast("struct<lon: double, lat: double>").alias("c_geo"), post.alias("pk"),
        # a total order that does not depend on how the file is split
        F.concat_ws(" ", padded(F.col("l_orderkey"), 12),
                    F.col("l_linenumber").cast("string"),
                    padded(F.col("l_partkey"), 12),
                    F.col("l_returnflag")).alias("ord"))


def railway_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line source: one row per order; urgent orders are high-speed lines."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    point = lambda k: F.array(longitude(k), latitude(k))
    return o.select(
        F.lit("ligne").alias("type_ligne"), key.cast("string").alias("code_ligne"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("LGV "), key.cast("string")))
        .otherwise(F.concat(F.lit("Ligne "), key.cast("string"))).alias("lib_ligne"),
        F.struct(F.struct(F.array(point(key), point(key + 1)).alias("coordinates"))
                 .alias("geometry")).alias("geo_shape"),
        key.alias("ord"))


def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = station_rows(spark, sf_dir)
    return build_nodes(rows.select(
        F.col("codes_uic").alias("uic"), F.col("nom").alias("name"),
        F.col("position_geographique.lat").alias("latitude"),
        F.col("position_geographique.lon").alias("longitude"), "ord"))


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = network_nodes(spark, sf_dir)
    return build_edges(line_stops(line_rows(spark, sf_dir), nodes), nodes,
                       line_attributes(railway_lines(spark, sf_dir)))


def nation_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations by hub: a supplier's nation."""
    nodes = network_nodes(spark, sf_dir)
    s = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("uic"), F.col("s_nationkey").cast("string").alias("hub"))
    return nodes.join(s, "uic").select("hub", "uic", "lat", "lon", "ord")


def network_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = network_edges(spark, sf_dir)
    walks = hub_transfers(nation_hubs(spark, sf_dir)).drop("hub")
    return both_directions(edges.unionByName(walks))


def hub_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One journey per nation: its first supplier to the last one of the next nation."""
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))
    n = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("a"), F.pmod(F.col("n_nationkey") + 1, F.lit(25)).alias("b"))
    return n.join(s.select(F.col("s_nationkey").alias("a"), "first"), "a").join(
        s.select(F.col("s_nationkey").alias("b"), "last"), "b").select(
        F.col("a").alias("rid"), F.col("first").cast("string").alias("origin"),
        F.col("last").cast("string").alias("goal"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("name"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_no): the orders numbered from 0 along their keys, whatever gaps the keys have.

    Work per row follows that is heavier than the row, so the numbers are dealt out again.
    """
    keys = read(spark, sf_dir, "orders").select("o_orderkey")
    numbered = indexed(keys, F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 100_000), "row_no")
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return numbered.select("row_no").repartition(tasks)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sentences, one per order, about places named like parts."""
    rows = order_rows(spark, sf_dir).withColumn("sentence_id", sequence_id(F.col("row_no") + 1))
    cells = planned_rows(rows, quota_plan(spark, read(spark, sf_dir, "orders").count()))
    return fill_slots(cells, template_table(spark), places(spark, sf_dir), "sentence_id")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: type is the model, value the duration, k the resource readings."""
    k = F.get_json_object("props", "$.k").cast("double")
    # the table holds UTC wall-clock times without a zone
    instant = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return read(spark, sf_dir, "events").select(
        "event_id", instant.alias("ts"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat(F.lit("request "), F.col("event_id").cast("string")).alias("input_text"),
        F.col("event_type").alias("model_name"), F.col("value").alias("duration_s"),
        k.alias("cpu_percent_avg"), (k * 10).alias("ram_peak_mb"),
        F.when(F.col("event_type") == "view", k * 5).alias("gpu_peak_mb"),
        F.when(k > 20, k / 1000).alias("carbon_kg"), F.col("props").alias("output"),
        F.lit("{}").alias("extra"), "user_id")
