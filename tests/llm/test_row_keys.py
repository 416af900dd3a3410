"""Rows that share an id or have none, and columns whose names clash with those used inside."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from railweave.llm import decontamination, mixing, near_duplicates, sharding, url_filter


def passage(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_classes_that_share_an_id_keep_their_links(spark):
    a, b = passage("a"), passage("b")
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (3, b + " tail"), (4, passage("c")), (None, a)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_stages_judge_rows_not_ids(spark, tmp_path):
    item = passage("q", 40)
    a, b = passage("a"), passage("b")
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, gone_id long, hash string"
    rows = [(i, t, "en", "s", 1, 1, 1, "h") for i, t in
            [(1, a), (5, a), (5, b), (5, b), (6, passage("f") + " " + item), (6, passage("g")), (None, item), (None, a)]]
    docs = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "unused")
    assert near.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in near.collect()) == [
        (0, "a0"), (0, "q0"), (1, "a0"), (5, "b0"), (6, "f0"), (6, "g0")]
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in clean.collect()) == [
        (0, "a0"), (1, "a0"), (5, "a0"), (5, "b0"), (5, "b0"), (6, "g0")]


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_mix_agrees_on_rows_of_one_id(spark):
    rows = [(None if i % 2 else 7, "s", passage("w", 1 + i * 7 % 23)) for i in range(40)] + [(i, "t", "x y z") for i in range(9)]
    answers = set()
    for seed in range(3):
        order = np.random.RandomState(seed).permutation(len(rows))
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, source string, text string").repartition(seed + 1)
        got = mixing.mix_sources(docs.withColumn("digest", F.md5("text")), tie=("digest",)).collect()
        answers.add(tuple(sorted((r["doc_id"] or 0, r["digest"], r["taken"]) for r in got)))
    assert len(answers) == 1


def test_columns_of_clashing_names_stay(spark):
    names = ["_rest", "_local", "_start", "_epochs", "_source", "_at", "rest", "part", "src", "order", "row", "words"]
    docs = spark.createDataFrame([(i, f"t{i}", "s" if i % 3 else "t", *range(700 + i, 712 + i)) for i in range(12)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    for got in (mixing.mix_sources(docs), sharding.interleave(docs, 2)):
        want = {r["doc_id"]: tuple(r[n] for n in names) for r in docs.collect()}
        assert {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()} == want
    pages = spark.createDataFrame(
        [(1, "http://a.net/x", "f", "h", "b", "u", 3), (1, "http://a.net/x", "f", "h", "b", "u", 3), (2, None, None, None, None, None, None),
         (3, "http://b.example.org/" + "long/" * 20_000, "f", "h", "b", "u", 3)],
        "page_id long, address string, fits string, _host string, best string, url string, page long")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules, url_filter.default_labels(spark), "address").collect()
    assert sorted((r["page_id"], r["fits"], r["_host"], r["best"], r["url"], r["rule"]) for r in got if r["page_id"] == 1) == [
        (1, "f", "h", "b", "u", "net/")] * 2
    assert len(got) == 4 and next(len(r["path"]) for r in got if r["page_id"] == 3) == 100_001
    assert url_filter.filter_urls(pages.limit(0), rules, url_filter.default_labels(spark), "address").count() == 0


def common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_paraphrases_of_items_of_one_sentence_against_all_pairs(spark):
    """All pairs of texts and items by the plain rule: found are the leaks, and none of the clean texts."""
    rng = np.random.RandomState(5)
    vocabulary = [f"word{i}" for i in range(600)]
    items = [" ".join(rng.choice(vocabulary, 40)) for _ in range(12)]
    items += [" ".join(rng.choice(vocabulary, 30)) + ". " + " ".join(rng.choice(vocabulary, 10)) for _ in range(8)]
    texts = [" ".join(rng.choice(vocabulary, 120)) for _ in range(40)]  # clean
    for k, item in enumerate(items):
        words = item.split()
        kept = [w if i >= 30 or i % 3 else "other" for i, w in enumerate(words)]  # 30 of 40 words, answer whole
        lost = [w if i % 3 else "other" for i, w in enumerate(words[:30])] + ["away"] * 10  # the answer is gone
        texts += [texts[k] + " " + item, " ".join(kept), " ".join(lost)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}
    want = set()
    for k, item in enumerate(items):
        mine = item.split()
        ends = [i for i, w in enumerate(mine[:-1]) if w[-1] in ".?!:"]
        answer = mine[ends[-1] + 1:] if ends else mine[-8:]
        for d, text in enumerate(texts):
            words = re.split(" ", text)
            n = common(mine, words)
            if n >= 0.8 * len(mine) or n >= 0.55 * len(mine) and common(answer, words) >= 0.8 * len(answer):
                want.add((d, k))
    assert len(want) >= 2 * len(items)
    assert got <= want and len(got & want) >= 0.95 * len(want)
    assert not {d for d, _ in got} & set(range(40))
