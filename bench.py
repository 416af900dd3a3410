"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from railweave import catalog  # noqa: E402
from railweave.session import local_session  # noqa: E402

HEADLINE = [
    "label_matrix", "language_label", "intent_label", "slots_extract", "artifact_clean",
    "language_metrics", "duplicate_texts", "distribution_sets", "slot_metrics", "edges_build",
    "edge_min", "shortest_paths", "pareto_skyline", "gazetteer_merge", "link_best",
    "place_mentions", "stratified_split", "bio_labels", "noise_augment", "request_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "16g"))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rates = {}
    for name, rows in (("label_matrix", documents), ("edges_build", lines)):
        if name in times:
            rates[name + "_rows_per_s"] = round(rows / times[name], 1)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores,
        "spark": spark.version, "start": "first run of each query in one session", **rates,
    }))


if __name__ == "__main__":
    main()
