"""Operators for training data: twins, brute force, held-out accuracy and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from railweave.llm import decontamination, language, mixing, near_duplicates, quality_classifier, quality_rules
from railweave.llm import sharding, substrings, toxicity, url_filter
from railweave.llm.components import components
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, row string"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns of clashing names."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, "a b c d e f g", "en", "s", 1, 5, 0.5, 1, "x"), (1, "a b c d e f g", "en", "s", 1, 5, 0.5, 1, "x"),
            (2, None, None, None, None, None, None, None, None), (None, "x y z", "de", None, 3, 1, 0.1, 2, "y"),
            (3, "", "fr", "s", 0, 0, 0.0, 0, ""), (4, " \t\n ", "fr", "t", 4, 1, 1.0, 3, "z"),
            (5, long, "en", "t", 9, 9, 0.9, 1, "l"), (6, long + " tail", "en", "t", 9, 9, 0.9, 1, "l"),
            (7, "ÄÖ 😀 ß", "de", "u", 5, 1, 0.2, 0, "u"), (8, "123 456", None, "u", 7, 2, 0.3, 0, "n")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("name", ["op1_interleave", "op4_odd_sketch", "op6_host_rules", "op9_substrings", "op10_mix"])
def test_twin(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), contract.queries()[name], contract.oracle_sql()[name], sf_dir)[2] == []


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name,label,modulus,rest", [("op3_quality", "quality", 5, 0), ("op8_toxicity", "toxic", 4, 2)])
def test_classifier_on_held_out(spark, name, label, modulus, rest):
    sf = "/root/testdata/sf0.1"
    got = contract.queries()[name](spark, sf).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (crc(r["doc_id"]) % modulus == rest) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.95


def test_quality_sample_keeps_the_mix_of_labels(spark):
    rows = [(i, "plain words of a text" if i % 2 else "$$ || ## ** !!") for i in range(4000)]
    good = {i: int(crc(f"q{i}") % 100 < (95 if i % 2 else 60)) for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    for per_label in (300, 10_000):
        got = quality_classifier.quality_scores(docs, labels, per_label).collect()
        for kind in (0, 1):
            held = [r for r in got if r["doc_id"] % 2 == kind]
            share = np.mean([good[r["doc_id"]] for r in held])
            assert abs(np.mean([r["score"] for r in held]) - share) < 0.05


def test_language_on_held_out(spark, tables, sf_dir):
    got = contract.queries()["op7_language"](spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in tables["documents"].select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.95


def test_forward_backward_equals_enumeration():
    rng = np.random.RandomState(0)
    emit, trans = rng.randn(1, 4, 3), rng.randn(3, 3)
    odds, _, _ = language.forward_backward(emit, np.array([4]), trans)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = np.exp(sum(emit[0, i, p] for i, p in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        for i, p in enumerate(path):
            want[i, p] += weight
    assert np.allclose(odds[0], want / want.sum(axis=1, keepdims=True))


def test_url_filter_equals_brute_force(spark, tables):
    weights = url_filter.train(url_filter.default_labels(spark))
    urls = [None, "", "no scheme", "HTTP://Casino-Bonus.EXAMPLE.net/x?y", "http://example.org/fr/a", "http://a.org/fr/",
            "http://example.com", "ftp://net/", "http://badnet/"] + [r["url"] for r in tables["pages"].collect()]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules, url_filter.default_labels(spark)).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        text = f"<{host}>{path}$"
        grams = [(ord(a) * 73856093 + ord(b) * 19349663 + ord(c) * 83492791) % (len(weights) - 1)
                 for a, b, c in zip(text, text[1:], text[2:])]
        odds = sum(weights[g] for g in grams) / max(1, len(grams)) ** 0.5 + weights[-1]
        want = max(fits)[1:] if fits else (None, "block" if odds > 0 else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *want)


def test_url_regression_separates_its_labels(spark):
    labelled = url_filter.default_labels(spark)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_filter.filter_urls(labelled, none, labelled).collect()
    assert all((r["verdict"] == "block") == bool(r["blocked"]) for r in got)


def chain_of_near_copies(spark):
    rng = np.random.RandomState(1)
    words = [f"v{i}" for i in rng.randint(0, 5000, 400)]
    rows = []
    for i in range(120):
        if i % 3 == 0:
            words[rng.randint(0, 400)] = f"new{i}"
        rows.append((1000 - i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [near_duplicates.BLOCK, 3000])
def test_near_duplicates_equal_brute_force(spark, block):
    docs = chain_of_near_copies(spark)
    sets = {r["doc_id"]: {tuple(w[k:k + 5]) for w in [WORD.findall(r["text"].lower())] for k in range(len(w) - 4)}
            for r in docs.collect()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if root[a] > root[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    got = near_duplicates.near_duplicates(docs, block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 50), (100, 70)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 70: 50}


def test_leaks_and_paraphrase(spark, tables):
    items = tables["benchmark"].collect()
    clean = [r["text"] for r in tables["documents"].orderBy("doc_id").limit(120).collect()]
    rows = [(i, t) for i, t in enumerate(clean)]
    for k, item in enumerate(items[:20]):
        words = item["text"].split()
        rows.append((1000 + k, f"{clean[k][:400]} {item['text']} {clean[k][:300]}"))
        if len(words) >= 25:  # a word in six is another one, but not in the answer
            rows.append((2000 + k, " ".join("other" if i % 6 == 0 and i < len(words) - 8 else w for i, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, tables["benchmark"], block_items=30).collect()}
    want = {(1000 + k, items[k]["item_id"]) for k in range(20)} | {(i, items[i - 2000]["item_id"]) for i, _ in rows if i >= 2000}
    assert want <= got


def test_common_subsequence_equals_table():
    rng = np.random.RandomState(2)
    for _ in range(30):
        a, b = rng.randint(0, 6, rng.randint(1, 30)), rng.randint(0, 6, rng.randint(0, 40))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_subsequence(a, b) == table[-1, -1]


def test_offending_sentences(spark):
    model = np.zeros(toxicity.BUCKETS + 1)
    model[-1] = -8
    cut, _ = toxicity.sentences(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    model[cut.features[0, 0]] = 16
    docs = spark.createDataFrame([(1, "all is well. you vile thing! bye"), (2, "fine")], "doc_id long, text string")
    assert [(r["doc_id"], r["sentence"], r["text"]) for r in toxicity.offending_sentences(docs, model).collect()] == [
        (1, 1, "you vile thing")]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert scores[1] > 0.9 > 0.1 > scores[2]


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 5), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 70.0, "b": 30.0, "c": 15.0, None: 0.0}


def test_host_verdicts_shrink(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 2 + [("good", False)] * 200 + [("tiny", True)]
    hosts = {r["h"]: r for r in quality_rules.host_verdicts(
        spark.createDataFrame(rows, "h string, base_failed boolean"), "h").collect()}
    assert not hosts["bad"]["host_kept"] and hosts["good"]["host_kept"]
    assert hosts["tiny"]["rate"] < 1


def test_odd_rows(spark, odd, tables):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for result in (sharding.interleave(odd, 3), mixing.mix_sources(odd), quality_rules.quality_rules(odd),
                   quality_classifier.quality_scores(odd, labels), toxicity.toxicity(odd, labels),
                   language.language_id(odd), near_duplicates.near_duplicates(odd), substrings.dedup_substrings(odd)):
        assert result.count() == n
    und = {r["doc_id"] for r in language.language_id(odd).filter(F.col("lang_pred") == "und").collect()}
    assert und == {2, 3, 4, 8}
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(odd).collect()}
    assert near[6] == 5 and near[2] == 2 and near[None] is None
    cut = {r["doc_id"]: r for r in substrings.dedup_substrings(odd).collect()}
    assert cut[6]["kept_text"] == "tail" and cut[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontamination.leaks(odd, tables["benchmark"]).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:4:2]:
        assert stage(spark, odd, "unused").columns == odd.columns


def test_substrings_of_rows_that_share_an_id(spark):
    def part(name, n=30):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(1, part("a")), (None, part("a") + " tail"), (None, part("b")), (None, part("c")), (None, part("c")),
            (None, part("c")), (None, "few words"), (None, "few words"), (None, None), (2, part("d")), (2, part("e")),
            (2, part("d")), (2, part("a") + " " + part("f"))]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted([
        (1, 30, 0, part("a")), (0, 31, 30, "tail"), (0, 30, 0, part("b")), (0, 30, 0, part("c")), (0, 30, 30, ""),
        (0, 30, 30, ""), (0, 2, 0, "few words"), (0, 2, 0, "few words"), (0, 0, 0, ""), (2, 30, 0, part("d")),
        (2, 30, 0, part("e")), (2, 30, 30, ""), (2, 60, 30, part("f"))])


def test_empty_tables(spark, odd, tables):
    docs = odd.limit(0)
    labels = tables["labels"].limit(0)
    for result in (sharding.interleave(docs, 3), mixing.mix_sources(docs), quality_rules.quality_rules(docs),
                   quality_classifier.quality_scores(docs, labels), toxicity.toxicity(docs, labels),
                   language.language_id(docs), near_duplicates.near_duplicates(docs),
                   substrings.dedup_substrings(docs), decontamination.leaks(docs, tables["benchmark"])):
        assert result.count() == 0
    assert decontamination.leaks(odd, tables["benchmark"].limit(0)).count() == 0


def test_pipeline(spark, sf_dir, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = tables["documents"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"]
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    leaked = {r["doc_id"] for r in decontamination.leaks(out, tables["benchmark"]).collect()}
    assert not leaked
    assert near_duplicates.near_duplicates(out.dropDuplicates(["doc_id"])).filter("not kept").count() == 0
