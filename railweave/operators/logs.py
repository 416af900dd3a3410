"""Request log and resource reports (E24-E26, F9, C10, batch form of L3-L5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railweave.operators.scale import in_ranges, with_neighbour

KWH_PER_KG = 50  # fixed value: kWh per kg of CO2


def latest(log: DataFrame, limit: int, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """the newest rows first."""
    return log.orderBy(F.desc(order), F.desc(tie)).limit(limit)


def without_payload(log: DataFrame) -> DataFrame:
    """The listing columns."""
    return log.drop("output", "extra")


def request_totals(log: DataFrame, last: int | None = None) -> DataFrame:
    """Requests and mean latency in milliseconds, of the whole log or of its ``last`` rows.

    A missing duration counts as 0.
    """
    log = log if last is None else latest(log, last)
    mean = F.avg(F.coalesce("duration_s", F.lit(0.0))) * 1000
    return log.agg(F.count(F.lit(1)).alias("total_requests"),
                   F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_latency_ms"))


def carbon_totals(log: DataFrame) -> DataFrame:
    """E25."""
    total = F.coalesce(F.sum(F.coalesce("carbon_kg", F.lit(0.0))), F.lit(0.0))
    return log.agg(F.round(total, 6).alias("total_emissions_kg"),
                   F.round(total * KWH_PER_KG, 4).alias("total_energy_kwh"),
                   F.count(F.lit(1)).alias("total_requests"), F.lit("FRA").alias("country"))


def resource_usage(snapshots: DataFrame, run: str = "run") -> DataFrame:
    """Mean and peak per run; a GPU that was never read stays NULL."""
    both = [f(c).alias(f"{c}_{name}") for c in ("cpu_percent", "ram_used_mb", "gpu_used_mb")
            for f, name in ((F.avg, "avg"), (F.max, "peak"))]
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return snapshots.groupBy(run).agg(*both, seconds.alias("duration_s"))


def requests_by_window(log: DataFrame, model: str = "model_name", width: str = "5 minutes",
                       slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count and mean latency per window and model; batch and streaming alike."""
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    return log.groupBy(frame.alias("w"), model).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.avg(F.coalesce("duration_s", F.lit(0.0))) * 1000).alias("avg_latency_ms")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), model,
        "requests", "avg_latency_ms")


def counter_rate(samples: DataFrame, series: str, value: str, width: str = "5 minutes",
                 slide: str = "15 seconds", ts: str = "ts") -> DataFrame:
    """L3: (max - min) / elapsed seconds per sliding window and series.

    Samples are first reduced to panes as wide as the slide, of which a window is made up exactly if its
    width is a multiple of the slide; so a sample is aggregated once and only panes are repeated.
    Streams keep both steps, as chained windows in append mode.
    """
    panes = samples.groupBy(F.window(ts, slide).alias("pane"), series).agg(
        F.min(value).alias("low"), F.max(value).alias("high"),
        F.min(F.unix_micros(ts)).alias("begin"), F.max(F.unix_micros(ts)).alias("end"))
    seconds = (F.max("end") - F.min("begin")) / 1e6
    return panes.groupBy(F.window("pane", width, slide).alias("w"), series).agg(
        (F.max("high") - F.min("low")).alias("grown"), seconds.alias("seconds")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), series,
        F.when(F.col("seconds") > 0, F.col("grown") / F.col("seconds")).alias("rate"))


def idle_share(rates: DataFrame) -> DataFrame:
    """L4: 1 - the mean rate of all series per window; ``rates`` comes from ``counter_rate``."""
    return rates.groupBy("window_start").agg((1 - F.avg("rate")).alias("busy_share"))


def without_resets(samples: DataFrame, series: str, value: str, order: str = "ts",
                   tie: str = "event_id", ranges: int | None = None) -> DataFrame:
    """L3 in batch: a counter that restarts keeps growing.

    The drop at each reset is found inside ranges of equal row counts, whose ends and sums
    are joined from small tables; so neither a long series nor a busy hour is one task.
    Adds ``grown``, the counter without its resets, relative to the first sample.
    """
    timed = in_ranges(samples.withColumn("_at", F.unix_micros(order)), series, "_at", [tie], ranges)
    before = with_neighbour(timed, series, "_at", [tie], [value], -1, "_prev_")
    previous = F.col(f"_prev_{value}")
    steps = before.withColumn("_step", F.when(previous.isNull(), F.lit(0.0)).when(
        F.col(value) < previous, F.col(value)).otherwise(F.col(value) - previous))
    sums = steps.groupBy(series, "_range").agg(F.sum("_step").alias("_sum"))
    ahead = Window.partitionBy(series).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(series).alias("_series"), F.col("_range").alias("_of"),
                         F.coalesce(F.sum("_sum").over(ahead), F.lit(0.0)).alias("_start"))
    local = Window.partitionBy(series, "_range").orderBy("_at", tie).rowsBetween(
        Window.unboundedPreceding, 0)
    same = F.col(series).eqNullSafe(F.col("_series")) & (F.col("_range") == F.col("_of"))
    return steps.withColumn("_run", F.sum("_step").over(local)).join(starts, same).select(
        *samples.columns, (F.col("_start") + F.col("_run")).alias("grown"))


def used_share(samples: DataFrame, total: str, available: str, width: str = "5 minutes",
               ts: str = "ts") -> DataFrame:
    """L4: 1 - available / total, averaged per window."""
    share = 1 - F.col(available) / F.nullif(F.col(total), F.lit(0))
    return samples.groupBy(F.window(ts, width).alias("w")).agg(F.avg(share).alias("used_share")
        ).select(F.col("w.start").alias("window_start"), "used_share")


def reset_safe_rate(samples: DataFrame, series: str, value: str, **windows: str) -> DataFrame:
    """L3 over reset-corrected counters."""
    return counter_rate(without_resets(samples, series, value), series, "grown", **windows)

