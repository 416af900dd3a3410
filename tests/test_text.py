"""B1-B12, J1, J3, J6-J8 on inline sentences."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from railweave.functions import labels, slots, text
from railweave.operators import ngram_language
from railweave.plans.components import Registry, UnknownComponent, score_in_batches
from railweave.plans.resolve import resolve

SENTENCES = [
    ("Je veux aller de Paris a Lyon", "Paris", "Lyon"),
    ("Paris vers Lyon", "Paris", "Lyon"),
    ("Je pars depuis Marseille a Bordeaux", "Marseille", "Bordeaux"),
    ("De Paris a Lyon en passant par Dijon", "Paris", "Lyon"),
    ("Paris puis Lyon puis Marseille", "Paris", "Marseille"),
    ("Je voudrais un billet de Nantes a Rennes", "Nantes", "Rennes"),
    ("Comment aller de Lille a Paris ?", "Lille", "Paris"),
    ("I want to go from Paris to Lyon", "Paris", "Lyon"),
    ("Paris to Lyon", "Paris", "Lyon"),
    ("From the Paris station to Lyon", "Paris", "Lyon"),
    ("From Paris to Lyon via Dijon", "Paris", "Lyon"),
    ("From Paris to Marseille through Lyon", "Paris", "Marseille"),
    ("I would like to travel from Nantes to Rennes please", "Nantes", "Rennes"),
]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_slots_of_fixture_sentences(spark):
    df = spark.createDataFrame(SENTENCES, "text string, dep string, dest string")
    for row in df.select("*", slots.extract_slots(F.col("text")).alias("s")).collect():
        assert row.dep in row.s.departure and row.dest in row.s.destination, row


def test_stops_and_fallback(spark):
    assert one(spark, slots.extract_slots, "Paris puis Lyon puis Nice").intermediate == ["Lyon"]
    assert one(spark, slots.extract_slots, "From Paris to Nice via Lyon").intermediate == ["Lyon"]
    got = one(spark, slots.extract_slots, "Lyon, Paris ; Nice")
    assert (got.departure, got.destination, got.intermediate) == ("Lyon", "Nice", ["Paris"])
    got = one(spark, slots.extract_slots, "bonjour")
    assert got.departure is None and got.destination is None and got.intermediate == []


@pytest.mark.parametrize("sentence,label", [
    ("Je veux aller de Paris a Lyon", "TRIP"), ("Paris vers Lyon", "TRIP"),
    ("Un train de Strasbourg à Mulhouse", "TRIP"), ("Ich möchte von Paris nach Lyon fahren", "TRIP"),
    ("", "UNKNOWN"), ("Il fait tres beau ce matin", "NOT_TRIP")])
def test_intent(spark, sentence, label):
    assert one(spark, labels.label_intent, sentence).label == label


@pytest.mark.parametrize("sentence,label,conf", [
    ("je veux un billet", "FRENCH", 0.5 + 2 / 3 * 0.5), ("I want the train", "ENGLISH", 0.5 + 4 / 5 * 0.5),
    ("hola gracias", "UNKNOWN", 0.7), ("xyz", "UNKNOWN", 0.4), ("", "UNKNOWN", 0.5),
    ("aller train", "FRENCH", 0.6), ("un train", "UNKNOWN", 0.5)])
def test_language(spark, sentence, label, conf):
    got = one(spark, labels.label_language, sentence)
    assert got.label == label and got.conf == pytest.approx(conf)


@pytest.mark.parametrize("raw,norm", [
    ("PARIS", "paris"), ("Paris-Lyon", "paris lyon"), ("Saint-Étienne", "saint etienne"),
    ("Gare de l'Est", "gare de l est"), ("  Paris  ", "paris"), ("", ""), ("Straßbourg œ", "strassbourg oe")])
def test_normalize_name(spark, raw, norm):
    assert one(spark, text.normalize_name, raw) == norm


def test_unicode_composition(spark):
    for value in ("été", "Việt", "plain", "Ångström"):
        want = unicodedata.normalize("NFC", value)
        assert one(spark, text.normalize_unicode_exact, value) == want
        assert one(spark, text.normalize_unicode, value) == want


def test_unicode_composition_of_any_text(spark):
    values = ["e\u0301a\u0323\u0302", "a\u0302\u0323", "q\u0307\u0323", "\u1112\u1161\u11ab\u1100\u1173\u11af", "\uac00\u11a8",
              "o" + "\u0323\u0302\u0301\u0300\u031b", "\u212b \u2126", "\u09c7\u09be", "\U00011099\U000110ba", "plain é", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select(
        "i", text.normalize_unicode(F.col("t")).alias("n"), text.clean_text(F.col("t")).alias("c"))
    for r in df.collect():
        want = None if values[r["i"]] is None else unicodedata.normalize("NFC", values[r["i"]])
        assert r["n"] == want and r["c"] == (want or "")


def test_artifacts(spark):
    assert one(spark, text.clean_artifacts, "[music] Bonjour ... [noise] toi") == "Bonjour toi"
    assert one(spark, text.is_pure_artifact, "[coupure] *bruit* …") is True


def test_spans(spark):
    df = spark.createDataFrame([("a  bb a",)], "t string").withColumn("tok", text.tokenize(F.col("t")))
    assert [(s.start, s.end) for s in df.select(text.token_spans("t", "tok")).first()[0]] == [(0, 1), (3, 5), (6, 7)]


def test_city_names(spark):
    assert one(spark, text.extract_city_name, "Paris Gare de Lyon") == "Paris"
    assert one(spark, text.extract_city_name, "Macon Loche TGV") == "Macon Loche"


def test_output_parsers(spark):
    got = one(spark, slots.parse_output_slots, "DEPART: Paris | ARRIVEE: aucun | VIA: Dijon, aucun , Lyon")
    assert (got.departure, got.destination, got.intermediate) == ("Paris", None, ["Dijon", "Lyon"])
    assert one(spark, labels.parse_output_label, "PAS_VOYAGE").label == "NOT_TRIP"
    assert one(spark, labels.parse_output_label, "?").conf == 0.5


def test_input_and_output_lines(spark):
    assert tuple(one(spark, labels.parse_input_line, "7, de Paris a Lyon, demain")) == ("7", "de Paris a Lyon, demain")
    assert tuple(one(spark, labels.parse_input_line, " Paris Lyon")) == ("AUTO", "Paris Lyon")
    df = spark.createDataFrame([("1", "a", "b", None), ("2", "a", None, "UNKNOWN"), ("3", None, None, "NOT_TRIP"),
                                ("4", "a", None, "NOT_FRENCH")], "i string, d string, t string, c string")
    got = [r[0] for r in df.select(labels.extraction_line(*map(F.col, "idtc"))).collect()]
    assert got == ["1,a,b", "2,a,?,UNKNOWN", "3,NOT_TRIP", "4,NOT_FRENCH"]


def test_resolve_downgrades_and_keeps_rows(spark):
    df = spark.createDataFrame([(1, "un train"), (2, "de Paris a Lyon"), (3, "")], "id int, text string")
    got = {r.id: r for r in resolve(df, "id").collect()}
    assert got[1].intent == "NOT_TRIP" and got[1].intent_conf == 0.5
    assert got[2].is_valid_trip and got[3].intent == "UNKNOWN"


def test_registry(spark):
    registry = Registry()
    assert set(registry.select("intent", "all")) == {"regex"}
    with pytest.raises(UnknownComponent):
        registry.select("language", "nothing")


def test_model_hook_loads_once_per_task_and_chunks(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, text string").coalesce(1)

    def load():
        return lambda texts: [("LONG" if len(t) > 4 else "SHORT", len(texts) / 10) for t in texts]

    got = {r.id: (r.label, r.conf) for r in score_in_batches(df, load, chunk=4).collect()}
    assert got[0] == ("SHORT", 0.4) and got[9] == ("LONG", 0.2) and len(got) == 10


def test_ngram_language_in_place_equals_join(spark):
    train = spark.createDataFrame([("fr", "le train pour la gare de Lyon"), ("en", "the train to the station"),
                                   ("en", "where is the next one"), (None, "ignored")], "lang string, text string")
    docs = spark.createDataFrame([(1, "la gare"), (2, "the  NEXT station"), (3, ""), (4, None), (5, "zzqq"),
                                  (6, "le train \U0001f682 the"), (7, "a"), (8, "la gare")], "id int, text string")
    profiles = ngram_language.train_profiles(train)
    near = {r.id: r.scores for r in ngram_language.score_languages(docs, profiles, "id").collect()}
    far = {r.id: r.scores for r in ngram_language.score_languages(docs, profiles, "id", max_cells=0).collect()}
    assert set(near) == set(far) == set(range(1, 9))
    assert near[1] == near[8] and all(near[i] is None and far[i] is None for i in (3, 4, 5, 7))
    for i in (1, 2, 6):
        assert [s.lang for s in near[i]] == [s.lang for s in far[i]] == ["en", "fr"]
        assert [s.score for s in near[i]] == pytest.approx([s.score for s in far[i]])
    found = {r.id: r.label for r in ngram_language.detect_languages(docs, profiles, "id").collect()}
    assert (found[1], found[2], found[3], found[5]) == ("FRENCH", "ENGLISH", "UNKNOWN", "UNKNOWN")


def test_token_spans_of_missing_rows_and_other_tokens(spark):
    rows = [(None, ["a"]), ("a b", None), ("", []), ("x\u00e9\U0001f600 b", ["x\u00e9\U0001f600", "zz", "b"])]
    df = spark.createDataFrame(rows, "t string, tok array<string>").coalesce(1)
    got = [r[0] if r[0] is None else [tuple(s) for s in r[0]] for r in df.select(text.token_spans("t", "tok")).collect()]
    assert got == [None, None, [], [(0, 3), (3, 5), (4, 5)]]


def test_token_spans_hold_little(spark):
    """A batch of many long texts is scanned row by row, without a Python object for each token and span."""
    import tracemalloc

    import pyarrow as pa

    tokens = ["ab"] * 2000
    texts, lists = pa.array([" ".join(tokens)] * 200), pa.array([tokens] * 200)
    tracemalloc.start()
    got = text.token_spans.func(texts, lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 200 and peak < 20_000_000


def test_via_keywords_are_searched_once_a_row(spark):
    from pyspark.sql import functions as F

    from railweave.functions import slots

    rows = [("de Paris via DIJON puis Lyon", [("Paris", 3), ("Dijon", 13), ("Lyon", 24)]),
            ("Paris, Dijon et Lyon", [("Paris", 0), ("Dijon", 7), ("Lyon", 16)]), (None, [("a", 0), ("b", 1), ("c", 2)])]
    df = spark.createDataFrame(rows, "text string, mentions array<struct<text: string, start: int>>")
    out = df.select(slots.roles_with_via(F.col("text"), F.col("mentions"))["intermediate"].alias("v"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1
    assert [r.v for r in out.collect()] == [["Dijon"], ["Dijon"], ["b"]]
