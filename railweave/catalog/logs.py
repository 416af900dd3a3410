"""Queries of the request-log jobs and streams (sections A10, A11, C10, E24-E26, F9, L)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from railweave.catalog import query, table
from railweave.catalog.network import ARCS, ASK, relaxed
from railweave.functions.labels import route_line
from railweave.operators import logs as G
from railweave.operators.scale import Stage
from railweave.plans import roles
from railweave.plans.resolve import resolve_routes
from railweave.sources import readers, writers
from railweave.streaming import jobs

LOG = """log AS (SELECT event_id, ts, event_type AS model_name, value AS duration_s, user_id, k AS cpu_percent_avg, k * 10 AS ram_peak_mb,
  CASE WHEN event_type = 'view' THEN k * 5 END AS gpu_peak_mb, CASE WHEN k > 20 THEN k / 1000 END AS carbon_kg
  FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events))"""


@query("latest_requests", f"WITH {LOG} SELECT event_id, model_name, duration_s FROM log ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_requests(spark, sf):
    """The last hundred requests without their payload (a listing)."""
    return G.without_payload(G.latest(roles.request_log(spark, sf), 100)).select("event_id", "model_name", "duration_s")


@query("request_totals", f"WITH {LOG} SELECT count(*) AS total_requests, round(avg(duration_s) * 1000, 2) AS avg_latency_ms FROM log")
def request_totals(spark, sf):
    """E24 over the whole log."""
    return G.request_totals(roles.request_log(spark, sf))


@query("recent_totals", f"WITH {LOG} SELECT count(*) AS total_requests, round(avg(duration_s) * 1000, 2) AS avg_latency_ms FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 100)")
def recent_totals(spark, sf):
    """E24 with F9: over the last hundred requests (the listing's own limit)."""
    return G.request_totals(roles.request_log(spark, sf), 100)


@query("carbon_totals", f"""WITH {LOG} SELECT round(sum(coalesce(carbon_kg, 0)), 6) AS total_emissions_kg, round(sum(coalesce(carbon_kg, 0)) * 50, 4) AS total_energy_kwh,
  count(*) AS total_requests, 'FRA' AS country FROM log""")
def carbon_totals(spark, sf):
    """E25."""
    return G.carbon_totals(roles.request_log(spark, sf))


@query("resource_usage", f"""WITH {LOG} SELECT user_id AS run, round(avg(cpu_percent_avg), 6) AS cpu_avg, max(cpu_percent_avg) AS cpu_peak, round(avg(ram_peak_mb), 6) AS ram_avg,
  max(ram_peak_mb) AS ram_peak, round(avg(gpu_peak_mb), 6) AS gpu_avg, max(gpu_peak_mb) AS gpu_peak, round(epoch_us(max(ts)) / 1e6::DOUBLE - epoch_us(min(ts)) / 1e6::DOUBLE, 3) AS duration_s FROM log GROUP BY 1""")
def resource_usage(spark, sf):
    """Snapshots per run."""
    snaps = roles.request_log(spark, sf).select(
        F.col("user_id").alias("run"), "ts", F.col("cpu_percent_avg").alias("cpu_percent"),
        F.col("ram_peak_mb").alias("ram_used_mb"), F.col("gpu_peak_mb").alias("gpu_used_mb"))
    u = G.resource_usage(snaps)
    return u.select(
        "run", F.round("cpu_percent_avg", 6).alias("cpu_avg"), F.col("cpu_percent_peak").alias("cpu_peak"),
        F.round("ram_used_mb_avg", 6).alias("ram_avg"), F.col("ram_used_mb_peak").alias("ram_peak"),
        F.round("gpu_used_mb_avg", 6).alias("gpu_avg"), F.col("gpu_used_mb_peak").alias("gpu_peak"),
        F.round("duration_s", 3).alias("duration_s"))


WINDOWS = f"""WITH {LOG} SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS window_start, model_name, count(*) AS requests, round(avg(duration_s) * 1000, 4) AS avg_latency_ms
FROM log GROUP BY 1, 2"""


def _windows(df):
    return df.select(F.unix_seconds("window_start").alias("window_start"), "model_name", "requests",
                     F.round("avg_latency_ms", 4).alias("avg_latency_ms"))


@query("request_windows", WINDOWS)
def request_windows(spark, sf):
    """L5 in batch."""
    return _windows(G.requests_by_window(roles.request_log(spark, sf)))


def _finish(stream, name):
    """Run a stream over what is there, in append mode, and return the windows that it closed."""
    stage = Stage(stream.sparkSession, name)
    out = f"{stage.root}/out"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", f"{stage.root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/batch=*")


def _late_log(spark, sf):
    """The log as JSON lines in three arrivals: the first half, one request, and the second half together
    with every tenth request of the first, which by then is late."""
    folder = Stage(spark, "log").root
    rows = roles.request_log(spark, sf)
    half = F.col("event_id") < rows.agg(F.max("event_id")).first()[0] // 2
    tenth = F.col("event_id") % 10 == 0
    first = rows.filter(half & ~tenth)
    last = first.agg(F.max("event_id")).first()[0]
    for part in (first.filter(F.col("event_id") != last), first.filter(F.col("event_id") == last),
                 rows.filter(~half | tenth)):
        writers.append_log(part.coalesce(1).drop("event_id", "ts", "user_id"), folder)
    return jobs.tail_log(spark, folder, 1)


#: The same arrivals: the watermark after the first one, in microseconds, and the rows it lets pass.
LATE = f"""{LOG}, half AS (SELECT max(event_id) // 2 AS h FROM log), last AS (SELECT max(event_id) AS l FROM log, half WHERE event_id < h AND event_id % 10 <> 0),
mark AS (SELECT max(epoch_us(ts)) - 600000000 AS early, (SELECT max(epoch_us(ts)) - 600000000 FROM log) AS final FROM log, half, last WHERE event_id < h AND event_id % 10 <> 0 AND event_id <> l),
tail AS (SELECT log.*, epoch_us(ts) AS t, event_id < h AND event_id % 10 = 0 AS late, early, final FROM log, half, mark)"""


def on_time(width: int) -> str:
    """Rows whose window of ``width`` microseconds is still open when they arrive."""
    return f"SELECT * FROM tail WHERE NOT late OR (t // {width} + 1) * {width} > early"


@query("stream_request_windows", f"""WITH {LATE} SELECT t // 300000000 * 300 AS window_start, model_name, count(*) AS requests, round(avg(duration_s) * 1000, 4) AS avg_latency_ms
FROM ({on_time(300000000)}) WHERE (t // 300000000 + 1) * 300000000 <= final GROUP BY 1, 2""")
def stream_request_windows(spark, sf):
    """Requests tailed as a stream, counted per window; late ones are dropped, closed windows leave the state."""
    return _windows(_finish(jobs.request_rates(_late_log(spark, sf)), "windows"))


@query("log_roundtrip", f"""WITH {LOG} SELECT input_text, model_name, duration_s, carbon_kg FROM (SELECT *, 'request ' || event_id AS input_text FROM log)""")
def log_roundtrip(spark, sf):
    """Appended twice over, read back."""
    folder = Stage(spark, "log").root
    rows = roles.request_log(spark, sf)
    writers.append_log(rows.filter("model_name = 'view'").drop("event_id", "ts", "user_id"), folder)
    writers.append_log(rows.filter("model_name <> 'view'").drop("event_id", "ts", "user_id"), folder)
    return readers.request_log(spark, folder).select("input_text", "model_name", "duration_s", "carbon_kg")


RATES = f"""WITH {LOG}, slid AS (SELECT model_name, cpu_percent_avg AS v, epoch_us(ts) AS t, s * 15 AS w
  FROM (SELECT *, unnest(range(epoch_us(ts) // 15000000 - 19, epoch_us(ts) // 15000000 + 1)) AS s FROM log))
SELECT w AS window_start, model_name, round(CASE WHEN max(t) > min(t) THEN (max(v) - min(v)) / ((max(t) - min(t)) / 1e6::DOUBLE) END, 6) AS rate FROM slid GROUP BY 1, 2"""


def _rates(df):
    return df.select(F.unix_seconds("window_start").alias("window_start"), "model_name", F.round("rate", 6).alias("rate"))


@query("counter_rates", RATES)
def counter_rates(spark, sf):
    """L3 in batch: five-minute rates every fifteen seconds."""
    return _rates(G.counter_rate(roles.request_log(spark, sf), "model_name", "cpu_percent_avg"))


@query("stream_counter_rates", f"""WITH {LATE}, slid AS (SELECT model_name, cpu_percent_avg AS v, t, s * 15 AS w, final FROM (SELECT *, unnest(range(t // 15000000 - 19, t // 15000000 + 1)) AS s FROM ({on_time(15000000)})))
SELECT w AS window_start, model_name, round(CASE WHEN max(t) > min(t) THEN (max(v) - min(v)) / ((max(t) - min(t)) / 1e6::DOUBLE) END, 6) AS rate FROM slid WHERE (w + 300) * 1000000 <= final GROUP BY 1, 2""")
def stream_counter_rates(spark, sf):
    """L3 as a stream: panes, then sliding windows of panes, each closed by the watermark."""
    return _rates(_finish(jobs.counter_rates(_late_log(spark, sf), "model_name", "cpu_percent_avg"), "rates"))


RAW_RATES = RATES.replace("SELECT w AS window_start, model_name, round(CASE", ", r AS (SELECT w AS window_start, model_name, (CASE").replace("END, 6) AS rate", "END) AS rate")


@query("idle_shares", f"{RAW_RATES}) SELECT window_start, round(1 - avg(rate), 6) AS busy_share FROM r GROUP BY 1")
def idle_shares(spark, sf):
    """L4, second gauge: one minus the mean idle rate of all series."""
    rates = G.counter_rate(roles.request_log(spark, sf), "model_name", "cpu_percent_avg")
    return G.idle_share(rates.withColumn("window_start", F.unix_seconds("window_start"))).select(
        "window_start", F.round("busy_share", 6).alias("busy_share"))


@query("counter_growth", f"""WITH {LOG}, s AS (SELECT event_id, model_name, cpu_percent_avg AS v, lag(cpu_percent_avg) OVER w AS b, ts FROM log WINDOW w AS (PARTITION BY model_name ORDER BY ts, event_id))
SELECT event_id, model_name, round(sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) OVER (PARTITION BY model_name ORDER BY ts, event_id), 6) AS grown FROM s""")
def counter_growth(spark, sf):
    """L3: counters without their resets."""
    g = G.without_resets(roles.request_log(spark, sf), "model_name", "cpu_percent_avg")
    return g.select("event_id", "model_name", F.round("grown", 6).alias("grown"))


SHARES = f"WITH {LOG} SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS window_start, round(avg(1 - cpu_percent_avg / nullif(ram_peak_mb, 0)), 6) AS used_share FROM log GROUP BY 1"


@query("used_shares", SHARES)
def used_shares(spark, sf):
    """L4 in batch."""
    u = G.used_share(roles.request_log(spark, sf), "ram_peak_mb", "cpu_percent_avg")
    return u.select(F.unix_seconds("window_start").alias("window_start"), F.round("used_share", 6).alias("used_share"))


@query("stream_used_shares", f"""WITH {LATE} SELECT t // 300000000 * 300 AS window_start, round(avg(1 - cpu_percent_avg / nullif(ram_peak_mb, 0)), 6) AS used_share
FROM ({on_time(300000000)}) WHERE (t // 300000000 + 1) * 300000000 <= final GROUP BY 1""")
def stream_used_shares(spark, sf):
    """L4 as a stream: closed windows only, late samples dropped."""
    u = _finish(jobs.used_shares(_late_log(spark, sf), "ram_peak_mb", "cpu_percent_avg"), "shares")
    return u.select(F.unix_seconds("window_start").alias("window_start"), F.round("used_share", 6).alias("used_share"))


@query("stream_resolve", f"""WITH {ARCS}, {ASK}, {relaxed('SELECT origin FROM ask')},
found AS (SELECT k, list_transform(path, lambda u: 'Supplier#' || lpad(u, 9, '0')) AS names, path FROM ask JOIN reach r ON r.origin = ask.origin AND r.node = goal)
SELECT 's' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN ', INVALID' WHEN 1 THEN ', INVALID' ELSE ', ' END AS head,
  CASE WHEN s_suppkey % 4 >= 2 THEN names[1] || ' > ' || names[-1] END AS ends
FROM supplier JOIN found ON k = s_suppkey UNION ALL
SELECT conv_id || '-' || turn || ', INVALID', NULL FROM conversations WHERE role = 'user'""")
def stream_resolve(spark, sf):
    """L2: lines arrive in three files and are resolved and routed batch by batch.

    A quarter of the suppliers' lines asks for an unknown station, a quarter makes no trip, the others get
    their route; the turns of the conversations name no station.
    """
    stage = Stage(spark, "lines")
    turns = table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.regexp_replace("text", r"\s+", " ").alias("text"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    to = s.select(F.col("k").alias("to"), F.col("name").alias("other"))
    kind = F.col("k") % 4
    asked = s.join(s.agg(F.count(F.lit(1)).alias("n"))).withColumn("to", F.pmod(F.col("k") + 1, F.col("n"))).join(to, "to").select(
        F.concat(F.lit("s"), F.col("k")).alias("id"),
        F.when(kind == 1, "Bonjour").otherwise(F.concat(
            F.lit("Je veux aller de "), "name", F.lit(" a "), F.when(kind == 0, "Zzyzzx").otherwise(F.col("other")))).alias("text"))
    lines = turns.unionAll(asked).select("id", F.concat("id", F.lit(", "), "text").alias("value"))
    for part in range(3):
        lines.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part).select("value").coalesce(1).write.mode("append").text(f"{stage.root}/in")
    nodes = stage.save(roles.network_nodes(spark, sf))
    arcs = stage.save(roles.network_arcs(spark, sf))

    def resolve(batch):
        done = resolve_routes(batch, "id", nodes, arcs)
        return done.select(route_line(F.col("id"), F.col("path"), F.col("error")).alias("value"))

    incoming = jobs.incoming_lines(spark, f"{stage.root}/in")
    run = jobs.resolve_stream(incoming, resolve, f"{stage.root}/out", os.path.basename(stage.root)).trigger(
        availableNow=True).start()
    run.awaitTermination()
    out = spark.read.text(f"{stage.root}/out").select(F.split("value", ", ").alias("v"))
    routed = F.element_at("v", 2) != "INVALID"
    return out.select(
        F.concat(F.element_at("v", 1), F.when(routed, ", ").otherwise(", INVALID")).alias("head"),
        F.when(routed, F.concat_ws(" > ", F.element_at("v", 2), F.element_at("v", -1))).alias("ends"))
