"""Numbering, splits, noise, BIO and validation invariants."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railweave.functions import bio
from railweave.functions import noise_tables as N
from railweave.functions.text import clean_artifacts
from railweave.operators import noise, validation
from railweave.operators import training as K
from railweave.operators.scale import hash_bucket, hash_key, number_rows, padded
from railweave.plans import roles
from railweave.sources import readers, writers


@pytest.fixture(scope="module")
def dataset(spark):
    places = spark.createDataFrame([(p,) for p in "Paris Lyon Lille Nice Nantes Rennes Brest Metz".split()]
                                   + [("Saint-Malo",), ("Le Mans",)], "name string")
    return K.generate_dataset(spark, 2000, places).cache()


def test_sparse_order_keys_lose_no_row(spark, tmp_path):
    spark.range(100).select((F.col("id") * 4).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p,) for p in "Paris Lyon Lille Nice".split()], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert roles.samples(spark, str(tmp_path)).select("sentence_id").distinct().count() == 100


def test_two_places_are_too_few(spark):
    with pytest.raises(Exception, match="three places"):
        K.generate_dataset(spark, 20, spark.createDataFrame([("Paris",), ("Lyon",)], "name string")).collect()


def test_spans_of_a_long_type(spark):
    kind = "X" * 150
    labels = [f"B-{kind}a", f"I-{kind}b"]
    assert spark.createDataFrame([(labels,)], "labels array<string>").select(
        F.size(bio.bio_spans(F.col("labels"), strict_type=True)).alias("n")).first().n == 2


def test_uncovered_row_is_an_error(spark):
    with pytest.raises(Exception, match="no cell of the plan for row 10"):
        K.planned_rows(spark.range(11).withColumnRenamed("id", "row_no"), K.quota_plan(spark, 10)).collect()


def test_long_keys_are_not_cut(spark):
    got = spark.createDataFrame([(7,), (10000,), (10001,)], "k long").select(padded(F.col("k"), 4, "S").alias("k"))
    assert [r.k for r in got.collect()] == ["SSS7", "10000", "10001"]


def test_json_lines_come_back_whole(spark, tmp_path):
    rows = [(str(i), f"s {i}", "TRIP", "FRENCH", "a", "b", "") for i in range(10)]
    writers.write_json(spark.createDataFrame(rows, readers.SAMPLES).coalesce(1), f"{tmp_path}/j")
    assert readers.samples_json(spark, f"{tmp_path}/j").count() == 10
    (tmp_path / "k.json").write_text('[\n{"sentence": "x",\n"intent": "TRIP"},\n{"sentence": "y"}\n]')
    assert readers.samples_json(spark, str(tmp_path / "k.json"), array_file=True).count() == 2


def test_numbering_equals_a_window(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("k"))
    key = hash_key(1, F.col("id"))
    got = number_rows(df, ["k"], [key, F.col("id")], hash_bucket(key))
    w = Window.partitionBy("k")
    want = df.select("id", "k", F.row_number().over(w.orderBy(key, "id")).cast("bigint").alias("rn"),
                     F.count("*").over(w).alias("n"))
    assert sorted(map(tuple, got.select("id", "k", "rn", "n").collect())) == sorted(map(tuple, want.collect()))


def test_numbering_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    key = hash_key(1, F.col("id"))
    assert number_rows(df, ["k"], [key], hash_bucket(key)).count() == 3


def test_quota_adds_up(spark):
    for total in (1, 7, 100, 99_999):
        rows = K.quota_plan(spark, total).collect()
        assert sum(r.n for r in rows) == total
    rows = {(r.intent, r.language, r.kind): r.n for r in K.quota_plan(spark, 100_000).collect()}
    assert sum(n for (i, *_), n in rows.items() if i == "TRIP") == 74_000
    assert rows["UNKNOWN", "UNKNOWN", "regular"] == 1_000
    assert rows["TRIP", "FRENCH", "intermediate"] == 9_990 and rows["TRIP", "FRENCH", "minimal"] == 6_660


def test_generated_rows(dataset):
    rows = dataset.collect()
    assert len(rows) == 2000 and len({r.sentence_id for r in rows}) == 2000
    for r in rows:
        slots = [s for s in (r.departure, r.destination, r.intermediate) if s]
        assert len(set(slots)) == len(slots) and all(s in r.sentence for s in slots)
        assert "{" not in r.sentence
        assert bool(r.destination) == (r.intent == "TRIP")


def test_split_sizes(dataset):
    parts = K.stratified_split(dataset, "sentence_id").groupBy("intent", "language", "split").count().collect()
    sizes = {}
    for r in parts:
        sizes.setdefault((r.intent, r.language), {})[r.split] = r["count"]
    for got in sizes.values():
        n = sum(got.values())
        assert got.get("train", 0) == int(n * 0.70) and got.get("val", 0) == int(n * 0.15)


def test_noise_keeps_labels_and_is_repeatable(dataset):
    first = {r.sentence_id: r for r in noise.augment(dataset).collect()}
    again = {r.sentence_id: r.sentence for r in noise.augment(dataset.repartition(3)).collect()}
    plan = {"STT" + r.sentence_id[4:]: r for r in noise.noise_plan(dataset).collect()}
    changed = 0
    for r in dataset.collect():
        noisy = first["STT" + r.sentence_id[4:]]
        assert again[noisy.sentence_id] == noisy.sentence
        assert (noisy.intent, noisy.departure, noisy.destination) == (r.intent, r.departure, r.destination)
        steps = plan[noisy.sentence_id].steps
        assert not (r.intent == "TRIP" and "incomplete" in steps)
        if r.intent == "UNKNOWN":
            assert noisy.sentence == r.sentence and plan[noisy.sentence_id].intensity is None
        if r.intent != "TRIP" and not steps:
            assert noisy.sentence == r.sentence
        changed += noisy.sentence != r.sentence
    assert changed > 300
    shares = [p.intensity for p in plan.values()]
    trips = sum(r.intent == "TRIP" for r in first.values())
    assert 0.35 < sum(s == "light" for s in shares) / trips < 0.5


def test_each_noise_step(spark):
    df = spark.createDataFrame([(str(i), "Bonjour je veux aller de Paris a Lyon, demain matin") for i in range(300)], "id string, t string")
    dice = noise.Dice(F.col("id"), 7)
    text = F.col("t")
    out = {name: [r[0] for r in df.select(step(text, dice)).collect()] for name, step in noise.TRANSFORMS}
    original = df.first().t
    n = len(original.split())
    assert all(1 <= len(t.split()) - n and len(set(t.split()) & {w for f in N.FILLERS for w in f.split()}) for t in out["filler_words"])
    assert all(len(t.split()) in (n, n + 1) for t in out["repetitions"])
    assert all(len(t.split()) <= n for t in out["incomplete"])
    assert all(any(h in t for h in N.HALLUCINATIONS) and original in t for t in out["hallucinations"])
    assert all(any(m in t for m in N.MARKERS) for t in out["noise_artifacts"])
    assert {t.lower() for t in out["capitalization_errors"]} == {original.lower()}
    assert len(set(out["capitalization_errors"])) > 3
    assert any("à" in t for t in out["homophones"]) and any("I want" in t or "to go" in t for t in out["code_switching"])
    assert any("veux... enfin" in t or "Bon... bonjour" in t for t in out["false_starts"])
    for name in ("phonetic_confusion", "punctuation_errors", "accent_variations"):
        assert len(set(out[name])) > 1, name
    words = [r[0] for r in df.select(noise.misspell_place(F.lit("Lyon"), dice)).collect()]
    assert "Lion" in words and "Lyon" in words


def test_numbers(spark):
    df = spark.createDataFrame([(str(i), "le train de 9 heures deux") for i in range(80)], "id string, t string")
    got = {r[0] for r in df.select(noise.vary_numbers(F.col("t"), noise.Dice(F.col("id"), 1))).collect()}
    assert any("neuf" in t for t in got) and any(" 2" in t for t in got)


def test_light_augmentation_spares_entities(dataset):
    got = noise.augment_lightly(dataset.filter("intent = 'TRIP' AND departure <> ''"), "sentence_id")
    for r in got.collect():
        for slot in (r.departure, r.destination):
            assert slot.lower() in r.sentence.lower()


def label(spark, sentence, dep, dest):
    df = spark.createDataFrame([(sentence.split(), dep, dest)], "t array<string>, d string, a string")
    return df.select(bio.label_exact(F.col("t"), F.col("d"), F.col("a"))).first()[0]


def test_exact_labels(spark):
    assert label(spark, "De Le Mans a Nice !", "Le Mans", "Nice") == ["O", "B-DEP", "I-DEP", "O", "B-DEST", "O"]
    assert label(spark, "a Paris, vers PARIS", "paris", "Paris") == ["O", "B-DEP", "O", "B-DEST"]
    assert label(spark, "rien", "x", "y") == ["O"]


def test_decode_and_roles(spark):
    df = spark.createDataFrame([("de Le Mans a Nice puis Lyon".split(),
                                 ["O", "B-DEP", "I-DEP", "O", "B-DEST", "O", "B-DEST"])], "t array<string>, l array<string>")
    got = df.select(bio.decode_slots(F.col("t"), F.col("l"))).first()[0]
    assert (got.departure, got.destination) == ("Le Mans", "Lyon")
    df = spark.createDataFrame([(["O", "b-loc", "I-LOC", "O", "B-LOC", "I-LOC"],)], "l array<string>")
    assert df.select(bio.location_roles(F.col("l"), F.lit(7))).first()[0] == ["O", "B-DEP", "I-DEP", "O", "B-DEST", "I-DEST", "O"]
    assert df.select(bio.location_roles(F.col("l"), F.lit(2))).first()[0] == ["O", "B-DEP"]


def test_normalised_labels_drop_what_does_not_align(spark):
    df = spark.createDataFrame([(["de", "Lyon"], "lyon", "", "TRIP"), (["rien"], "x", "y", "TRIP"),
                                (["Saint-Malo"], "Saint-Malo", "", "TRIP"), (["x"], "", "", "NOT_TRIP")],
                               "t array<string>, d string, a string, i string")
    got = [r[0] for r in df.select(bio.label_normalised(*map(F.col, "tdai"))).collect()]
    assert got == [["O", "B-DEP"], None, None, ["O"]]


def test_leaks(spark):
    rows = [("train", "a"), ("train", "a"), ("test", "a"), ("val", "b"), ("test", "c"), ("val", "c"), ("train", None)]
    got = K.leak_check(spark.createDataFrame(rows, "split string, value string"))
    assert sorted(map(tuple, got.collect())) == [("test", "train", 1), ("test", "val", 1)]


def test_validation(spark):
    rows = [("1", "ok", "TRIP", "a", "b", ""), ("2", " ", "TRIP", "", "b", ""), ("3", "x", None, "", "", ""), ("4", "", "UNKNOWN", "q", "", "")]
    df = spark.createDataFrame(rows, "sentence_id string, sentence string, intent string, departure string, destination string, intermediate string")
    errors = [tuple(r) for r in validation.row_rules(df).collect()]
    assert ("2", "TRIP missing departure") in errors and ("2", "Empty sentence for non-UNKNOWN intent") in errors
    assert ("3", "Invalid intent 'None'") in errors and ("4", "UNKNOWN should not have departure/destination") in errors
    assert len(errors) == 4
    names = spark.createDataFrame([("a",)], "name string")
    assert validation.verdict(df, names).first().passed is False
    assert [r.field for r in validation.missing_fields(df.drop("intent")).collect()] == ["intent"]


def test_noise_markers_are_cleaned_again(spark):
    df = spark.createDataFrame([(m + " Paris",) for m in N.MARKERS], "t string")
    assert {r[0] for r in df.select(clean_artifacts(F.col("t"))).collect()} == {"Paris"}


def test_decoding_fits_the_labels_once_a_row(spark):
    rows = [(["a", "b", "c", "d", "e"], ["B-DEP", "I-DEP", "O", "B-DEST", "I-DEST", "O"]), (["x"], ["I-DEP"]), ([], []), (None, ["O"])]
    df = spark.createDataFrame(rows, "tokens array<string>, labels array<string>")
    from railweave.functions import bio
    out = df.select(bio.decode_slots(df["tokens"], df["labels"]).alias("d"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("slice(labels") == 1
    assert [(r.d.departure, r.d.destination) if r.d else None for r in out.collect()[:3]] == [("a b", "d e"), (None, None), (None, None)]
