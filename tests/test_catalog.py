"""Registered queries against their SQL twins, on the smallest tables.

All of them: python tests/run_oracles.py /root/testdata/sf0.01
"""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SAMPLE = ["name_normalize", "language_label", "intent_label", "slots_extract", "sentence_code", "artifact_clean",
          "language_confusion", "metric_averages", "slot_metrics", "duplicate_texts", "gazetteer_merge",
          "resolve_names", "link_topk", "edges_build", "shortest_paths", "pareto_skyline", "stratified_split",
          "bio_labels", "noise_plan", "noise_augment", "light_augment", "row_rules", "shingle_leaks",
          "request_windows", "stream_request_windows", "counter_growth", "place_mentions", "ngram_language"]


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(q.__doc__ for q in contract.queries().values())


def test_entry(spark, sf_dir):
    assert contract.entry(spark).columns == ["lang", "language", "intent", "n"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    build, sql = contract.queries()[name], contract.oracle_sql()[name]
    assert compare(spark, connect(sf_dir), build, sql, sf_dir)[2] == []
