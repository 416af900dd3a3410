"""The bounded sample of labelled documents against a plain sort."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from railweave.llm import labelled


@pytest.mark.parametrize("per_value", [1, 7, 5000])
def test_sample_equals_plain_sort(spark, per_value):
    labels = [(i, 0 if i % 3 else 1) for i in range(3000)] + [(i, 1) for i in range(10)] + [(None, 1), (5, None)]
    docs = [(i, f"text {i}") for i in range(0, 2500)] + [(4, "again"), (None, "no id")]
    got = labelled.labelled_sample(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, mark int"),
        "mark", F.col("doc_id") % 5 != 0, per_value, ["doc_id", "text"]).collect()
    marks = {}
    for i, y in labels:
        if i is not None and y is not None and i % 5 and i < 2500:
            marks[i] = max(y, marks.get(i, 0))
    want = set()
    for y in (0, 1):
        ids = sorted((i for i in marks if marks[i] == y), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        want |= {(i, text, y) for i in ids[:per_value] for d, text in docs if d == i}
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_sample_without_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, mark int")
    for some, known in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        assert labelled.labelled_sample(some, known, "mark", F.lit(True), 3, ["text"]).count() == 0
