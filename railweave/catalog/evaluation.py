"""Queries of the evaluation jobs (section E, C4-C6, D20, D21, D24, G3, H3, A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave.catalog import query, table
from railweave.catalog import sql as S
from railweave.functions import labels
from railweave.functions.slots import extract_slots
from railweave.operators import metrics as M
from railweave.plans import roles
from railweave.sources.writers import report_document

TRUE_LANG = "CASE lang WHEN 'fr' THEN 'FRENCH' WHEN 'en' THEN 'ENGLISH' ELSE 'UNKNOWN' END"
LANG_PAIRS = f"""{S.language_ctes('documents')},
pairs AS (SELECT doc_id, {TRUE_LANG} AS y_true, label AS y_pred, {TRUE_LANG} AS language FROM documents JOIN lang_pred USING (doc_id))"""
INTENT_PAIRS = f"""{S.intent_ctes('documents')},
pairs AS (SELECT doc_id, CASE quality WHEN 1 THEN 'TRIP' ELSE 'NOT_TRIP' END AS y_true, label AS y_pred, {TRUE_LANG} AS language
  FROM documents JOIN labels USING (doc_id) JOIN intent_pred USING (doc_id))"""


def language_pairs(spark, sf):
    """True language beside the keyword label."""
    truth = labels.language_of_code(F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id", truth.alias("y_true"), labels.label_language(F.col("text"))["label"].alias("y_pred"),
        truth.alias("language"))


def intent_pairs(spark, sf):
    """The quality label as intent beside the keyword intent; texts are labelled before the join."""
    found = table(spark, sf, "documents").select(
        "doc_id", labels.label_intent(F.col("text"))["label"].alias("y_pred"),
        labels.language_of_code(F.col("lang")).alias("language"))
    return found.join(intent_truth(spark, sf), "doc_id").select("doc_id", "y_true", "y_pred", "language")


def intent_truth(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "TRIP").otherwise("NOT_TRIP").alias("y_true"))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def matrix_sql(pairs, classes):
    columns = ", ".join(f"count(*) FILTER (y_pred = '{c}') AS \"{c}\"" for c in classes)
    return f"""WITH {pairs} SELECT c AS y_true, {', '.join(f'coalesce("{c}", 0) AS "{c}"' for c in classes)}
FROM (SELECT unnest({S.listed(classes)}) AS c) LEFT JOIN (SELECT y_true, {columns} FROM pairs GROUP BY 1) ON c = y_true"""


@query("language_confusion", matrix_sql(LANG_PAIRS, labels.LANGUAGES))
def language_confusion(spark, sf):
    """E13."""
    return M.confusion_matrix(language_pairs(spark, sf), labels.LANGUAGES)


@query("intent_confusion", matrix_sql(INTENT_PAIRS, labels.INTENTS))
def intent_confusion(spark, sf):
    """E13 with an empty row."""
    return M.confusion_matrix(intent_pairs(spark, sf), labels.INTENTS)


@query("confusion_shares", f"""WITH m AS ({matrix_sql(INTENT_PAIRS, labels.INTENTS)})
SELECT y_true, {', '.join(f'round(CASE WHEN "TRIP" + "NOT_TRIP" + "UNKNOWN" = 0 THEN 0 ELSE "{c}" / ("TRIP" + "NOT_TRIP" + "UNKNOWN") END, 6)::DOUBLE AS "{c}"' for c in labels.INTENTS)} FROM m""")
def confusion_shares(spark, sf):
    """Row-normalised."""
    matrix = M.confusion_matrix(intent_pairs(spark, sf), labels.INTENTS)
    return rounded(M.normalise_matrix(matrix, labels.INTENTS), *labels.INTENTS)


def flags_sql(pairs, classes, keys=""):
    k = f"{keys}, " if keys else ""
    return f"""{pairs}, flags AS (SELECT {k}class, y_true = class AS t, y_pred = class AS p
  FROM pairs, (SELECT unnest({S.listed(classes)}) AS class)), {S.class_metrics('flags', keys)}"""


@query("language_metrics", f"""WITH {flags_sql(LANG_PAIRS, labels.LANGUAGES)}
SELECT class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM metrics""")
def language_metrics(spark, sf):
    """E6, E7, B30."""
    m = M.class_metrics(M.class_counts(language_pairs(spark, sf), labels.LANGUAGES))
    return rounded(m, "precision", "recall", "f1")


@query("metric_averages", f"""WITH {flags_sql(INTENT_PAIRS, labels.INTENTS)}
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1
FROM metrics""")
def metric_averages(spark, sf):
    """Macro and support-weighted."""
    m = M.class_metrics(M.class_counts(intent_pairs(spark, sf), labels.INTENTS))
    both = M.macro_average(m).join(M.weighted_average(m))
    return rounded(both, *both.columns)


@query("accuracy_languages", f"""WITH {INTENT_PAIRS}
SELECT coalesce(language, 'ALL') AS language, count(*) FILTER (y_true = y_pred) AS correct, count(*) AS total,
  round(count(*) FILTER (y_true = y_pred) / count(*), 6) AS accuracy FROM pairs GROUP BY ROLLUP (language)""")
def accuracy_languages(spark, sf):
    """Overall and per language bucket."""
    return rounded(M.accuracy_by_language(intent_pairs(spark, sf)), "accuracy")


@query("language_gate", f"""WITH {S.language_ctes('documents')}, {INTENT_PAIRS}
SELECT count(*) AS total, count(*) FILTER (y_true = y_pred) AS correct, count(*) FILTER (label = 'FRENCH') AS gated_total,
  count(*) FILTER (label = 'FRENCH' AND y_true = y_pred) AS gated_correct
FROM pairs JOIN lang_pred USING (doc_id)""")
def language_gate(spark, sf):
    """Accuracy on all rows and on those labelled French, in one pass."""
    rows = table(spark, sf, "documents").select(
        "doc_id", labels.label_intent(F.col("text"))["label"].alias("y_pred"),
        labels.label_language(F.col("text"))["label"].alias("lang_pred")
    ).join(intent_truth(spark, sf), "doc_id")
    ok, gate = F.col("y_true") == F.col("y_pred"), F.col("lang_pred") == "FRENCH"
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"),
                    F.count_if(gate).alias("gated_total"), F.count_if(gate & ok).alias("gated_correct"))


@query("label_union", f"WITH {INTENT_PAIRS} SELECT y_true AS label FROM pairs UNION SELECT y_pred FROM pairs")
def label_union(spark, sf):
    """H3."""
    return M.union_labels(intent_pairs(spark, sf))


# --- labelled sentences --------------------------------------------------------------

SAMPLES = S.sample_ctes()


@query("distribution_sets", f"""WITH {SAMPLES}
SELECT intent, language, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM samples), 6)::DOUBLE AS pct
FROM samples GROUP BY GROUPING SETS ((intent), (language), (intent, language))""")
def distribution_sets(spark, sf):
    """E1."""
    return rounded(M.distribution(roles.samples(spark, sf)), "pct")


@query("sample_profile", f"""WITH {SAMPLES}
SELECT count(*) AS total, round(avg(length(sentence)), 6) AS avg_length, min(length(sentence)) AS min_length,
  max(length(sentence)) AS max_length,
  count(*) FILTER (lower(sentence) = sentence AND regexp_matches(sentence, '\\p{{L}}') AND intent = 'TRIP') AS lowercase_trips,
  count(*) FILTER (intermediate <> '') AS with_intermediate, count(*) FILTER (intent = 'TRIP') AS trips,
  count(*) FILTER (intent = 'TRIP' AND intermediate <> '') AS with_stop,
  round(count(*) FILTER (intent = 'TRIP' AND intermediate <> '') / count(*) FILTER (intent = 'TRIP'), 6) AS share FROM samples""")
def sample_profile(spark, sf):
    """E2, E3."""
    s = roles.samples(spark, sf)
    return rounded(M.length_profile(s).join(M.stop_share(s)), "avg_length", "share")


@query("duplicate_texts", """SELECT md5(text) AS text, n FROM (
  SELECT text, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, sha256(text) LIMIT 10)""")
def duplicate_texts(spark, sf):
    """The ten most repeated texts (a report)."""
    return M.duplicates(table(spark, sf, "documents"), "text").select(F.md5("text").alias("text"), "n")


SLOT_ROWS = f"""{SAMPLES}, trips AS (SELECT * FROM samples WHERE intent = 'TRIP'),
{S.slot_ctes('trips', 'sentence_id', 'sentence')},
scored AS (SELECT sentence_id, sentence, trim(nullif(s.departure, '')) AS td, trim(nullif(s.destination, '')) AS tt,
  trim(nullif(p.departure, '')) AS pd, trim(nullif(p.destination, '')) AS pt
  FROM trips s JOIN slot_pred p USING (sentence_id))"""


def slot_rows(spark, sf):
    """C4: TRIP sentences with true and extracted slots."""
    s = roles.samples(spark, sf).filter("intent = 'TRIP'")
    return M.normalised_slots(s.select(
        "sentence_id", "sentence", F.col("departure").alias("true_dep"),
        F.col("destination").alias("true_dest"), extract_slots(F.col("sentence")).alias("s")).select(
        "*", F.col("s.departure").alias("pred_dep"), F.col("s.destination").alias("pred_dest")))


@query("slot_metrics", f"""WITH {SLOT_ROWS},
long AS (SELECT 'departure' AS slot, td AS t, pd AS p FROM scored UNION ALL SELECT 'destination', tt, pt FROM scored)
SELECT slot, count(*) FILTER (t = p) AS tp, count(*) FILTER (p IS NOT NULL AND p IS DISTINCT FROM t) AS fp,
  count(*) FILTER (t IS NOT NULL AND p IS DISTINCT FROM t) AS fn, count(*) FILTER (t IS NULL AND p IS NULL) AS tn
FROM long GROUP BY slot""")
def slot_metrics(spark, sf):
    """E10."""
    return M.slot_metrics(slot_rows(spark, sf))


@query("joint_accuracy", f"""WITH {SLOT_ROWS},
f AS (SELECT td IS NOT DISTINCT FROM pd AND tt IS NOT DISTINCT FROM pt AS ok,
  coalesce(td <> '' AND NOT contains(lower(sentence), lower(td)), false) OR coalesce(tt <> '' AND NOT contains(lower(sentence), lower(tt)), false) AS odd,
  coalesce(regexp_matches(sentence, '^\\P{{L}}*\\p{{Ll}}'), false) AS low FROM scored)
SELECT count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (odd) AS misspelling_total,
  count(*) FILTER (odd AND ok) AS misspelling_correct, count(*) FILTER (low) AS lowercase_total,
  count(*) FILTER (low AND ok) AS lowercase_correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM f""")
def joint_accuracy(spark, sf):
    """E11."""
    return rounded(M.joint_accuracy(slot_rows(spark, sf)), "accuracy")


GRID = f"""{SAMPLES}, {S.intent_ctes('samples', 'sentence_id', 'sentence')}, {S.slot_ctes('samples', 'sentence_id', 'sentence')},
iv AS (SELECT sentence_id, 'keywords' AS intent_model, label AS pred_intent FROM intent_pred UNION ALL
  SELECT sentence_id, 'always trip', 'TRIP' FROM samples),
sv AS (SELECT sentence_id, 'patterns' AS slot_model, nullif(departure, '') AS pd, nullif(destination, '') AS pt FROM slot_pred UNION ALL
  SELECT sentence_id, 'none', NULL, NULL FROM samples),
grid AS (SELECT *, s.intent AS true_intent, nullif(s.departure, '') AS td, nullif(s.destination, '') AS tt, (row_no % 10)::DOUBLE AS latency_ms
  FROM samples s JOIN iv USING (sentence_id) JOIN sv USING (sentence_id))"""


def grid(spark, sf):
    """Two classifiers x two extractors."""
    s = roles.samples(spark, sf).withColumn(
        "row_no", F.substring("sentence_id", 5, 20).cast("bigint") - 1)
    none = F.lit(None).cast("string")
    truth = s.select(
        F.col("sentence_id").alias("sample_id"), F.col("intent").alias("true_intent"),
        F.nullif("departure", F.lit("")).alias("true_dep"), F.nullif("destination", F.lit("")).alias("true_dest"),
        F.explode(F.array(
            F.struct(F.lit("keywords").alias("m"), labels.label_intent(F.col("sentence"))["label"].alias("v")),
            F.struct(F.lit("always trip").alias("m"), F.lit("TRIP").alias("v")))).alias("i"),
        (F.col("row_no") % 10).cast("double").alias("latency_ms"))
    found = extract_slots(F.col("sentence"))
    slots = s.select(F.col("sentence_id").alias("sample_id"), found.alias("f")).select(
        "sample_id", F.explode(F.array(
            F.struct(F.lit("patterns").alias("m"), F.nullif(F.col("f.departure"), F.lit("")).alias("d"),
                     F.nullif(F.col("f.destination"), F.lit("")).alias("t")),
            F.struct(F.lit("none").alias("m"), none.alias("d"), none.alias("t")))).alias("s")).select(
        "sample_id", F.col("s.m").alias("slot_model"), F.col("s.d").alias("pred_dep"), F.col("s.t").alias("pred_dest"))
    return M.model_grid(truth.select("*", F.col("i.m").alias("intent_model"), F.col("i.v").alias("pred_intent")).drop("i"), slots)


@query("combined_grid", f"""WITH {GRID}
SELECT intent_model, slot_model, count(*) AS intent_total, count(*) FILTER (pred_intent = true_intent) AS intent_correct,
  count(*) FILTER (true_intent = 'TRIP') AS slot_total,
  count(*) FILTER (true_intent = 'TRIP' AND pd IS NOT DISTINCT FROM td AND pt IS NOT DISTINCT FROM tt) AS slot_correct,
  round(avg(latency_ms), 6) AS avg_latency_ms, round(count(*) FILTER (pred_intent = true_intent) / count(*), 6) AS intent_accuracy,
  round(count(*) FILTER (true_intent = 'TRIP' AND pd IS NOT DISTINCT FROM td AND pt IS NOT DISTINCT FROM tt) / count(*) FILTER (true_intent = 'TRIP'), 6) AS slot_accuracy
FROM grid GROUP BY 1, 2""")
def combined_grid(spark, sf):
    """E12, D20."""
    return rounded(M.combined_results(grid(spark, sf)), "avg_latency_ms", "intent_accuracy", "slot_accuracy")


# --- comparisons of models and runs: each event is one scored prediction -----------------

RUNS = """pred AS (SELECT event_type AS model, value AS latency_ms, event_id % 2 AS run,
  CASE WHEN value > 10 THEN 1 ELSE 0 END AS correct FROM events),
acc AS (SELECT model, run, avg(correct) AS accuracy FROM pred GROUP BY 1, 2),
delta AS (SELECT a.model, a.accuracy AS before, b.accuracy AS after, b.accuracy - a.accuracy AS delta
  FROM acc a JOIN acc b ON a.model = b.model AND a.run = 0 AND b.run = 1)"""


def run_accuracy(spark, sf, run=None):
    e = table(spark, sf, "events")
    if run is not None:
        e = e.filter(F.col("event_id") % 2 == run)
    return e.groupBy(F.col("event_type").alias("model")).agg(
        F.avg((F.col("value") > 10).cast("double")).alias("accuracy"))


@query("model_latency", "SELECT event_type AS model, round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY 1")
def model_latency(spark, sf):
    """E19 (the median column is a sketch and is left out here)."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency_ms"))
    return rounded(M.mean_latency(e).drop("p50_latency_ms"), "avg_latency_ms")


@query("run_delta", f"WITH {RUNS} SELECT model, round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta FROM delta")
def run_delta(spark, sf):
    """D21."""
    return rounded(M.run_delta(run_accuracy(spark, sf, 0), run_accuracy(spark, sf, 1)), "before", "after", "delta")


@query("model_ranking", f"""WITH {RUNS}, m AS (SELECT model, avg(correct) AS accuracy FROM pred GROUP BY 1)
SELECT model, round(accuracy, 6) AS accuracy, round(accuracy - (SELECT accuracy FROM m WHERE model = 'view'), 6) AS delta FROM m""")
def model_ranking(spark, sf):
    """G3."""
    return rounded(M.rank_models(run_accuracy(spark, sf), "view"), "accuracy", "delta")


@query("best_model", f"""WITH {RUNS} SELECT model, round(accuracy, 6) AS accuracy FROM
  (SELECT model, avg(correct) AS accuracy FROM pred GROUP BY 1 ORDER BY accuracy DESC, model LIMIT 1)""")
def best_model(spark, sf):
    """E22."""
    return rounded(M.best_model(run_accuracy(spark, sf)), "accuracy")


@query("stage_impact", f"""WITH {RUNS} SELECT 'forward' AS stage, round(avg(delta), 6) AS mean_delta FROM delta UNION ALL
SELECT 'back', round(avg(-delta), 6) FROM delta""")
def stage_impact(spark, sf):
    """E23."""
    a, b = run_accuracy(spark, sf, 0), run_accuracy(spark, sf, 1)
    return rounded(M.stage_impact(("forward", M.run_delta(a, b)), ("back", M.run_delta(b, a))), "mean_delta")


@query("report_document", f"""WITH {LANG_PAIRS}
SELECT 'language' AS section, 'regex' AS model, round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM pairs""")
def report(spark, sf):
    """The nested report, read back through its JSON text."""
    acc = M.accuracy_by_language(language_pairs(spark, sf).withColumn("model", F.lit("regex")), ["model"])
    section = acc.filter("language = 'ALL'").select("model", F.round("accuracy", 6).alias("accuracy"), F.col("total").alias("n"))
    document = report_document({"language": section, "runs": run_accuracy(spark, sf)})
    text = document.select(F.to_json(F.struct("*")).alias("j"))
    return text.select(F.lit("language").alias("section"), F.lit("regex").alias("model"),
                       F.get_json_object("j", "$.language.regex.accuracy").cast("double").alias("accuracy"),
                       F.get_json_object("j", "$.language.regex.n").cast("bigint").alias("n"))
