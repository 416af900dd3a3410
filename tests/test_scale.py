"""Neighbours and running sums along rows that are cut into ranges."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from railweave.operators import logs, scale


def test_neighbours_across_ranges(spark):
    rng = random.Random(3)
    # one group with a single position, bunched positions, a null group
    rows = [(("same", "hot", "b", None)[rng.randrange(4)], rng.choice([1, 1, 1, 2, 900]), i) for i in range(400)]
    rows = [(g, 5 if g == "same" else p, i) for g, p, i in rows]
    df = spark.createDataFrame(rows, "g string, p int, i int")
    want_next, want_prev = {}, {}
    for group in {r[0] for r in rows}:
        line = sorted(r[1:] for r in rows if r[0] == group)
        want_next |= {a[1]: b[1] for a, b in zip(line, line[1:])}
        want_prev |= {b[1]: a[1] for a, b in zip(line, line[1:])}
    ranged = scale.in_ranges(df, "g", "p", ["i"], ranges=17)
    assert ranged.select("_range").distinct().count() > 5
    after = scale.with_neighbour(ranged, "g", "p", ["i"], ["i"], 1, "n_").collect()
    before = scale.with_neighbour(ranged, "g", "p", ["i"], ["i"], -1, "p_").collect()
    assert len(after) == len(before) == len(rows)
    assert {r.i: r.n_i for r in after} == {r[2]: want_next.get(r[2]) for r in rows}
    assert {r.i: r.p_i for r in before} == {r[2]: want_prev.get(r[2]) for r in rows}


def test_resets_inside_one_busy_second(spark):
    rng = random.Random(4)
    rows = [(i, ("a", "b", None)[i % 3], float(rng.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id int, s string, v double").selectExpr(
        "*", "timestamp_seconds(1700000000 + event_id div 100) AS ts")
    got = {r.event_id: r.grown for r in logs.without_resets(df, "s", "v", ranges=11).collect()}
    total, last = {}, {}
    for i, s, v in rows:
        total[s] = total.get(s, 0.0) + (0.0 if s not in last else v if v < last[s] else v - last[s])
        last[s] = v
        assert got[i] == pytest.approx(total[s])
    assert len(got) == len(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, p int, i int")
    assert scale.with_neighbour(scale.in_ranges(df, "g", "p", ["i"]), "g", "p", ["i"], ["i"], 1, "n_").count() == 0


def test_neighbours_need_no_second_shuffle(spark):
    df = spark.createDataFrame([(f"g{i % 3}", i, i) for i in range(30)], "g string, p int, i int")
    ranged = scale.in_ranges(df, "g", "p", ["i"], ranges=5)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scale.with_neighbour(ranged, "g", "p", ["i"], ["i"], 1, "n_")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" not in plan


def test_splits_without_rows_are_no_tasks(spark, tmp_path):
    """One row group in a file of many splits is read by one task, so its rows are dealt out."""
    rng = random.Random(5)
    rows = pa.table({"i": list(range(4000)), "t": [rng.randbytes(60).hex() for _ in range(4000)]})
    pq.write_table(rows, tmp_path / "whole.parquet")
    pq.write_table(rows, tmp_path / "parts.parquet", row_group_size=200)
    pq.write_table(rows.slice(0, 0), tmp_path / "none.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}
    held = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        cores = spark.sparkContext.defaultParallelism
        whole = spark.read.parquet(str(tmp_path / "whole.parquet"))
        assert whole.rdd.getNumPartitions() >= cores
        dealt = scale.spread(whole)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= cores and max(sizes) < 4000 / cores
        assert sorted(r.i for r in dealt.collect()) == list(range(4000))
        parts = spark.read.parquet(str(tmp_path / "parts.parquet"))
        assert parts.rdd.getNumPartitions() >= cores
        assert scale.spread(parts) is parts  # even splits are not shuffled
        none = spark.read.parquet(str(tmp_path / "none.parquet"))
        assert scale.spread(none).count() == 0
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
