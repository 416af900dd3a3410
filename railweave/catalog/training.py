"""Queries of the training-set jobs (sections E15-E17, F6-F8, F10, G2, G5, H5, H6, J16, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave.catalog import noise_sql, query, table
from railweave.catalog import sql as S
from railweave.functions import bio
from railweave.functions import noise_tables as N
from railweave.functions.text import token_spans, words
from railweave.operators import bio_metrics as BM
from railweave.operators import noise, validation
from railweave.operators import training as K
from railweave.operators.scale import Stage, hash_bucket, hash_key, number_rows
from railweave.plans import roles
from railweave.sources import readers, writers

SAMPLES = S.sample_ctes()
ALL = "sentence_id, sentence, intent, language, departure, destination, intermediate"


@query("slot_fill", f"WITH {SAMPLES} SELECT {ALL} FROM samples")
def slot_fill(spark, sf):
    """One labelled sentence per order, places from part names."""
    return roles.samples(spark, sf)


@query("quota_cells", f"WITH {SAMPLES} SELECT intent, language, kind, count(*) AS n FROM samples GROUP BY 1, 2, 3")
def quota_cells(spark, sf):
    """K2: how many orders fall into each cell of the plan."""
    orders = roles.order_rows(spark, sf)
    cells = K.planned_rows(orders, K.quota_plan(spark, orders.count()))
    return cells.groupBy("intent", "language", "kind").agg(F.count(F.lit(1)).alias("n"))


SPLIT = f"""{SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY intent, language ORDER BY {S.hash_key(42, 'sentence_id')}, sentence_id) AS rn,
  count(*) OVER (PARTITION BY intent, language) AS n FROM samples),
split AS (SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM r)"""


@query("stratified_split", f"WITH {SPLIT} SELECT sentence_id, intent, language, part AS split FROM split")
def stratified_split(spark, sf):
    """Skew-safe numbering inside each stratum."""
    return K.stratified_split(roles.samples(spark, sf), "sentence_id").select("sentence_id", "intent", "language", "split")


@query("document_split", f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {S.hash_key(7, 'doc_id')}, doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def document_split(spark, sf):
    """K3 on documents: one language holds more than half of the rows."""
    return K.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", ["lang"], seed=7).select("doc_id", "split")


@query("place_split", f"""WITH r AS (SELECT place, row_number() OVER (ORDER BY {S.hash_key(42, 'place')}) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT p_name AS place FROM part UNION SELECT DISTINCT c_name FROM customer))
SELECT place, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def place_split(spark, sf):
    """K4."""
    names = roles.places(spark, sf).union(table(spark, sf, "customer").select("c_name"))
    return K.split_places(names)


@query("seeded_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {S.hash_key(5, 'o_orderkey')}, o_orderkey) AS rank FROM orders")
def seeded_shuffle(spark, sf):
    """The place of every row in a repeatable shuffle."""
    key = hash_key(5, F.col("o_orderkey"))
    return number_rows(table(spark, sf, "orders").select("o_orderkey"), [], [key, F.col("o_orderkey")],
                       hash_bucket(key), "rank").drop("n")


@query("sequence_ids", "SELECT c_custkey, 'CUST' || lpad((c_custkey + 1)::VARCHAR, greatest(6, length((c_custkey + 1)::VARCHAR))::INT, '0') AS id FROM customer")
def sequence_ids(spark, sf):
    """gap-free ids along the key."""
    c = table(spark, sf, "customer").select("c_custkey")
    numbered = K.indexed(c, F.col("c_custkey"), F.floor(F.col("c_custkey") / 1000))
    return numbered.select("c_custkey", K.sequence_id(F.col("idx") + 1, "CUST").alias("id"))


# --- BIO ---------------------------------------------------------------------------------

def token_sql(column):
    return f"regexp_extract_all({column}, '\\S+')"


def window_sql(tokens, target):
    """List of 1-based starts where the token window equals the target words."""
    return (f"list_filter(range(1, greatest(len({tokens}) - len({target}) + 2, 1)), lambda i: len({target}) > 0 AND "
            f"{tokens}[i:i + len({target}) - 1] = {target})")


BIO = f"""{SAMPLES}, tok AS (SELECT sentence_id, intent, {token_sql('sentence')} AS tokens,
  list_transform({token_sql('sentence')}, lambda t: regexp_replace(lower(t), '[.,!?;:''\"]+$', '')) AS plain,
  {token_sql('lower(departure)')} AS dep, {token_sql('lower(destination)')} AS dest FROM samples),
w1 AS (SELECT *, {window_sql('plain', 'dep')}[1] AS ds, {window_sql('plain', 'dest')} AS ts FROM tok),
w2 AS (SELECT *, list_filter(ts, lambda i: ds IS NULL OR NOT (i < ds + len(dep) AND i + len(dest) > ds))[1] AS tt FROM w1),
bio AS (SELECT sentence_id, intent, tokens, list_transform(range(1, len(tokens) + 1), lambda i:
  CASE WHEN intent <> 'TRIP' THEN 'O' WHEN i = ds THEN 'B-DEP' WHEN i > ds AND i < ds + len(dep) THEN 'I-DEP'
    WHEN i = tt THEN 'B-DEST' WHEN i > tt AND i < tt + len(dest) THEN 'I-DEST' ELSE 'O' END) AS labels FROM w2)"""


@query("bio_labels", f"WITH {BIO} SELECT sentence_id AS id, intent, array_to_string(tokens, ' ') AS tokens, array_to_string(labels, ' ') AS labels FROM bio")
def bio_labels(spark, sf):
    """K6."""
    return K.bio_samples(roles.samples(spark, sf)).select(
        "id", "intent", F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


def norm_sql(column):
    return f"trim(regexp_replace(translate(lower({column}), '''-', '  '), '\\s+', ' ', 'g'))"


@query("bio_normalised", f"""WITH {SAMPLES}, odd AS (SELECT sentence_id, intent, replace(sentence, ' a ', ' l''a ') AS s, departure, upper(destination) AS destination FROM samples),
tok AS (SELECT sentence_id, intent, {token_sql('s')} AS tokens, list_transform({token_sql('s')}, lambda t: {norm_sql('t')}) AS plain,
  {token_sql(norm_sql('departure'))} AS dep, {token_sql(norm_sql('destination'))} AS dest FROM odd),
w AS (SELECT *, {window_sql('plain', 'dep')}[1] AS ds, {window_sql('plain', 'dest')}[1] AS ts FROM tok),
l AS (SELECT *, ds IS NOT NULL AND ts >= ds AND ts < ds + len(dep) AS inside FROM w)
SELECT sentence_id AS id, CASE WHEN intent = 'NOT_TRIP' OR NOT (intent = 'TRIP' AND ds IS NULL AND ts IS NULL AND len(dep) + len(dest) > 0) THEN
  array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN intent = 'NOT_TRIP' THEN 'O' WHEN i = ds THEN 'B-DEP' WHEN i > ds AND i < ds + len(dep) THEN 'I-DEP'
    WHEN coalesce(inside, false) THEN 'O' WHEN i = ts THEN 'B-DEST' WHEN i > ts AND i < ts + len(dest) THEN 'I-DEST' ELSE 'O' END), ' ') END AS labels FROM l""")
def bio_normalised(spark, sf):
    """K7."""
    s = roles.samples(spark, sf).withColumns({
        "tokens": words(F.replace("sentence", F.lit(" a "), F.lit(" l'a "))), "destination": F.upper("destination")})
    return s.select(F.col("sentence_id").alias("id"), F.array_join(bio.label_normalised(
        F.col("tokens"), F.col("departure"), F.col("destination"), F.col("intent")), " ").alias("labels"))


LOC_LABELS = """CASE WHEN l_linenumber % 3 = 1 THEN 'B-LOC' WHEN l_linenumber % 3 = 2 THEN 'I-LOC' ELSE 'o' END"""


@query("role_labels", f"""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, {LOC_LABELS} AS lab FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
r AS (SELECT k, i, lab, sum(CASE WHEN lab = 'B-LOC' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS c FROM t),
x AS (SELECT k, list(CASE lab WHEN 'B-LOC' THEN CASE WHEN c = 1 THEN 'B-DEP' ELSE 'B-DEST' END WHEN 'I-LOC' THEN CASE WHEN c <= 1 THEN 'I-DEP' ELSE 'I-DEST' END ELSE 'O' END ORDER BY i) AS ls FROM r GROUP BY 1)
SELECT k, array_to_string(list_concat(ls, ['O', 'O', 'O', 'O', 'O'])[1:5], ' ') AS labels FROM x""")
def role_labels(spark, sf):
    """K8, F8: places by order of appearance, fitted to five tokens."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    lab = F.when(F.col("l_linenumber") % 3 == 1, "B-LOC").when(F.col("l_linenumber") % 3 == 2, "I-LOC").otherwise("o")
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(
        F.struct("l_linenumber", lab.alias("lab")))), lambda x: x["lab"]).alias("labels"))
    return rows.select("k", F.array_join(bio.location_roles(F.col("labels"), F.lit(5)), " ").alias("labels"))


CHAR = f"""{SAMPLES}, pieces AS (SELECT sentence_id, unnest(regexp_extract_all(sentence, '\\s+|\\S+')) AS p, generate_subscripts(regexp_extract_all(sentence, '\\s+|\\S+'), 1) AS i FROM samples),
pos AS (SELECT sentence_id, i, p, sum(length(p)) OVER (PARTITION BY sentence_id ORDER BY i) - length(p) AS s, sum(length(p)) OVER (PARTITION BY sentence_id ORDER BY i) AS e FROM pieces),
tokn AS (SELECT sentence_id, list({{'s': s, 'e': e}} ORDER BY i) AS sp FROM pos WHERE trim(p) <> '' GROUP BY 1),
ent AS (SELECT sentence_id, lower(sentence) AS t, lower(departure || 'zz') AS d, lower(destination) AS g, sp FROM samples JOIN tokn USING (sentence_id)),
len AS (SELECT *, list_filter(range(length(d), least(length(d), 3) - 1, -1), lambda k: contains(t, left(d, k::INT)))[1] AS dk,
  CASE WHEN g <> '' THEN list_filter(range(length(g), least(length(g), 3) - 1, -1), lambda k: contains(t, left(g, k::INT)))[1] END AS gk FROM ent),
ext AS (SELECT *, instr(t, left(d, dk::INT)) - 1 AS da, instr(t, left(g, gk::INT)) - 1 AS ga FROM len),
hit AS (SELECT *, CASE WHEN dk IS NOT NULL THEN list_filter(range(1, len(sp) + 1), lambda i: sp[i].s < da + dk AND sp[i].e > da) END AS dh,
  CASE WHEN gk IS NOT NULL THEN list_filter(range(1, len(sp) + 1), lambda i: sp[i].s < ga + gk AND sp[i].e > ga) END AS gh FROM ext)"""


@query("character_labels", f"""WITH {CHAR}
SELECT sentence_id AS id, array_to_string(list_transform(range(1, len(sp) + 1), lambda i: CASE WHEN i = gh[1] THEN 'B-DEST' WHEN list_contains(gh, i) THEN 'I-DEST'
  WHEN i = dh[1] THEN 'B-DEP' WHEN list_contains(dh, i) THEN 'I-DEP' ELSE 'O' END), ' ') AS labels FROM hit""")
def character_labels(spark, sf):
    """K9: character spans; the altered departure is found by its longest prefix."""
    s = roles.samples(spark, sf).withColumn("tokens", words(F.col("sentence"))).withColumn(
        "spans", token_spans("sentence", "tokens"))
    labels = bio.label_by_characters(F.col("sentence"), F.col("spans"), {
        "DEP": F.concat("departure", F.lit("zz")), "DEST": F.col("destination")})
    return s.select(F.col("sentence_id").alias("id"), F.array_join(labels, " ").alias("labels"))


# true labels by K6, predicted ones differ: a destination counts as a departure in every
# fifth row, and the second token of a span is lost in every seventh
PRED = f"""{BIO}, lab AS (SELECT *, substr(sentence_id, 5)::BIGINT AS k FROM bio),
both_labels AS (SELECT sentence_id, k, tokens, labels AS t, list_transform(labels, lambda x: CASE WHEN k % 7 = 0 AND starts_with(x, 'I-') THEN 'O'
  WHEN k % 5 = 0 THEN replace(x, 'DEST', 'DEP') ELSE x END) AS p FROM lab)"""


def predicted(spark, sf):
    s = K.bio_samples(roles.samples(spark, sf)).withColumn("k", F.substring("id", 5, 20).cast("bigint"))
    changed = F.transform("labels", lambda x: F.when(
        (F.col("k") % 7 == 0) & F.startswith(x, F.lit("I-")), "O").when(
        F.col("k") % 5 == 0, F.replace(x, F.lit("DEST"), F.lit("DEP"))).otherwise(x))
    return s.select("id", "tokens", F.col("labels").alias("true_labels"), changed.alias("pred_labels"))


TOKENS = f"{PRED}, tokens AS (SELECT unnest(t) AS y_true, unnest(p) AS y_pred FROM both_labels)"


@query("token_metrics", f"""WITH {TOKENS}, c AS (SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp,
  count(*) FILTER (y_true = label AND y_pred <> label) AS fn, count(*) FILTER (y_true = y_pred) / count(*) AS accuracy FROM tokens, (SELECT unnest({S.listed(bio.LABELS)}) AS label) GROUP BY 1),
r AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM c)
SELECT label, tp, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / greatest(precision + recall, 1e-9::DOUBLE), 6) AS f1, tp + fn AS support FROM r""")
def token_metrics(spark, sf):
    """E15, D24."""
    m = BM.token_metrics(predicted(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query("token_confusion", f"""WITH {TOKENS}
SELECT y_true, {', '.join(f"count(*) FILTER (y_pred = '{v}') AS \"{v}\"" for v in bio.LABELS)} FROM tokens GROUP BY 1""")
def token_confusion(spark, sf):
    """E16."""
    return BM.token_confusion(predicted(spark, sf))


def spans_sql(labels, source):
    """CTEs of strict spans: (sentence_id, side, type, s, e)."""
    return f"""lt_{labels} AS (SELECT sentence_id, generate_subscripts({labels}, 1) AS i, unnest({labels}) AS l FROM {source}),
lp_{labels} AS (SELECT *, lag(l) OVER (PARTITION BY sentence_id ORDER BY i) AS b FROM lt_{labels}),
lb_{labels} AS (SELECT *, starts_with(l, 'B-') OR (starts_with(l, 'I-') AND (coalesce(b, 'O') = 'O' OR substr(b, 3) <> substr(l, 3))) AS begins FROM lp_{labels}),
lg_{labels} AS (SELECT *, sum(CASE WHEN begins OR l = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY sentence_id ORDER BY i) AS g FROM lb_{labels}),
sp_{labels} AS (SELECT sentence_id, max(substr(l, 3)) AS type, min(i) AS s, max(i) AS e FROM lg_{labels} WHERE l <> 'O' GROUP BY sentence_id, g)"""


@query("entity_metrics", f"""WITH {PRED}, {spans_sql('t', 'both_labels')}, {spans_sql('p', 'both_labels')},
n AS (SELECT coalesce(a.type, b.type) AS type, count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS tp, count(a.s) AS support, count(b.s) AS n_pred
  FROM sp_t a FULL JOIN sp_p b ON a.sentence_id = b.sentence_id AND a.type = b.type AND a.s = b.s AND a.e = b.e GROUP BY 1),
m AS (SELECT * FROM n UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(support)::BIGINT, sum(n_pred)::BIGINT FROM n),
r AS (SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END::DOUBLE AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END::DOUBLE AS recall FROM m)
SELECT type, tp, support, n_pred, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END::DOUBLE, 6) AS f1 FROM r""")
def entity_metrics(spark, sf):
    """E17."""
    m = BM.entity_metrics(predicted(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("bio_spans", f"""WITH {PRED}, {spans_sql('p', 'both_labels')} SELECT sentence_id AS id, type, s - 1 AS start_at, e AS end_at FROM sp_p""")
def bio_spans(spark, sf):
    """F7 with the scoring rule."""
    spans = bio.bio_spans(F.col("pred_labels"), strict_type=True)
    return predicted(spark, sf).select("id", F.explode(spans).alias("s")).select(
        "id", "s.type", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


# runs begin at B- labels only; I- labels of any type carry on
DECODE = f"""{PRED}, x AS (SELECT sentence_id, generate_subscripts(p, 1) AS i, unnest(p) AS l, unnest(tokens) AS w FROM both_labels),
g AS (SELECT *, sum(CASE WHEN NOT starts_with(l, 'I-') THEN 1 ELSE 0 END) OVER (PARTITION BY sentence_id ORDER BY i) AS g FROM x),
s AS (SELECT sentence_id, g, arg_min(l, i) AS first, string_agg(w, ' ' ORDER BY i) AS txt FROM g GROUP BY 1, 2)"""


@query("bio_decode", f"""WITH {DECODE} SELECT b.sentence_id AS id, arg_max(txt, g) FILTER (starts_with(first, 'B-') AND contains(first, 'DEP')) AS departure,
  arg_max(txt, g) FILTER (starts_with(first, 'B-') AND contains(first, 'DEST')) AS destination FROM both_labels b LEFT JOIN s USING (sentence_id) GROUP BY 1""")
def bio_decode(spark, sf):
    """last span of each type."""
    d = bio.decode_slots(F.col("tokens"), F.col("pred_labels"))
    return predicted(spark, sf).select("id", d.alias("d")).select("id", "d.departure", "d.destination")


# --- generation, noise, checks -------------------------------------------------------------

@query("split_build", f"""WITH {BIO}, r AS (SELECT id, intent, n FROM (SELECT 'GEN_TRIP_train_' || sentence_id AS id, intent, len(tokens) AS n FROM bio WHERE intent = 'TRIP'
  UNION ALL SELECT 'GEN_NOT_TRIP_train_' || doc_id, 'NOT_TRIP', len({token_sql('text')}) FROM documents))
SELECT id, intent, n::BIGINT AS n_tokens, 'train' AS split FROM r""")
def split_build(spark, sf):
    """K5, H5: generated TRIP sentences plus documents as other sentences."""
    orders = roles.order_rows(spark, sf)
    rows = K.planned_rows(orders.withColumn("sentence_id", K.sequence_id(F.col("row_no") + 1)),
                          K.quota_plan(spark, orders.count())).filter("intent = 'TRIP'")
    other = table(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence")).withColumnRenamed("doc_id", "sentence_id")
    built = K.build_split("train", rows, K.template_table(spark), roles.places(spark, sf), other, "sentence_id")
    return built.select("id", "intent", F.size("tokens").alias("n_tokens"), "split")


# the labels of the sentences that K11 touched, by the same CTEs as those of the plain ones
TOUCHED = f"""{SAMPLES}, {noise_sql.LIGHT}, touched AS (SELECT s.* REPLACE (CASE WHEN {S.uniform(42, S.quoted('augment'), 's.sentence_id')} < 0.3
  THEN l.sentence ELSE s.sentence END AS sentence) FROM samples s JOIN light l USING (sentence_id)), {BIO[len(SAMPLES) + 2:].replace('FROM samples', 'FROM touched')}"""


@query("split_augmented", f"""WITH {TOUCHED}
SELECT 'GEN_TRIP_train_' || sentence_id AS id, intent, array_to_string(labels, ' ') AS labels FROM bio WHERE intent = 'TRIP'
UNION ALL SELECT 'GEN_NOT_TRIP_train_' || doc_id, 'NOT_TRIP', array_to_string(list_transform({token_sql('text')}, lambda w: 'O'), ' ') FROM documents""")
def split_augmented(spark, sf):
    """K5 with K11 on about 30 % of the rows."""
    orders = roles.order_rows(spark, sf)
    rows = K.planned_rows(orders.withColumn("sentence_id", K.sequence_id(F.col("row_no") + 1)),
                          K.quota_plan(spark, orders.count())).filter("intent = 'TRIP'")
    other = table(spark, sf, "documents").select(F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence"))
    return K.build_split("train", rows, K.template_table(spark), roles.places(spark, sf), other,
                         "sentence_id", augment=True).select("id", "intent", F.array_join("labels", " ").alias("labels"))


def gate_sql(step):
    i = N.STEPS.index(step)
    chance = "CASE intensity " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in N.PROFILES.items()) + " ELSE 0 END"
    extra = " AND intent <> 'TRIP'" if step == "incomplete" else ""
    return f"CASE WHEN intensity IS NOT NULL AND {S.uniform(42, "sentence_id", S.quoted(step), S.quoted('gate'))} < {chance}{extra} THEN '{step}' END"


INTENSITY = f"""CASE WHEN intent = 'TRIP' THEN CASE {' '.join(f"WHEN {S.uniform(42, 'sentence_id', S.quoted('intensity'))} < {end} THEN '{name}'" for name, end in N.INTENSITY_ENDS)} END
  WHEN intent = 'NOT_TRIP' AND {S.uniform(42, 'sentence_id', S.quoted('touch'))} < 0.3 THEN
    CASE WHEN {S.hash_int(42, 'sentence_id', S.quoted('light or moderate'))} % 2 = 0 THEN 'light' ELSE 'moderate' END END"""


@query("noise_plan", f"""WITH {SAMPLES}, i AS (SELECT sentence_id, intent, {INTENSITY} AS intensity FROM samples)
SELECT sentence_id, intensity, array_to_string(list_filter([{', '.join(gate_sql(s) for s, _ in noise.TRANSFORMS)}], lambda s: s IS NOT NULL), ' ') AS steps FROM i""")
def noise_plan(spark, sf):
    """Intensity and steps of every row."""
    return noise.noise_plan(roles.samples(spark, sf)).select("sentence_id", "intensity", F.array_join("steps", " ").alias("steps"))


NOISY, NOISY_LAST = noise_sql.noisy_ctes(INTENSITY)


@query("noise_augment", f"""WITH {SAMPLES}, {NOISY}
SELECT 'STT' || substr(sentence_id, 5) AS sentence_id, t AS sentence, intent, language, departure, destination, intermediate FROM {NOISY_LAST}""")
def noise_augment(spark, sf):
    """K10, K10a-d: the noisy sentences."""
    return noise.augment(roles.samples(spark, sf))


@query("noise_untouched", f"""WITH {SAMPLES}, i AS (SELECT *, {INTENSITY} AS intensity FROM samples),
p AS (SELECT *, list_filter([{', '.join(gate_sql(s) for s, _ in noise.TRANSFORMS)}], lambda s: s IS NOT NULL) AS steps FROM i)
SELECT 'STT' || substr(sentence_id, 5) AS sentence_id, intent, departure, destination,
  CASE WHEN len(steps) = 0 AND intent <> 'TRIP' THEN sentence WHEN steps = ['hallucinations'] AND intent <> 'TRIP' THEN
    CASE WHEN {S.hash_int(42, 'sentence_id', S.quoted('hallucination'), S.quoted('side'))} % 2 = 0 THEN {S.listed(N.HALLUCINATIONS)}[1 + {S.hash_int(42, 'sentence_id', S.quoted('hallucination'))} % 12] || ' ' || sentence
    ELSE sentence || ' ' || {S.listed(N.HALLUCINATIONS)}[1 + {S.hash_int(42, 'sentence_id', S.quoted('hallucination'))} % 12] END END AS sentence FROM p""")
def noise_untouched(spark, sf):
    """Labels of every row, and the text where no step or only the stock phrase applies."""
    samples = roles.samples(spark, sf)
    plan = noise.noise_plan(samples).withColumn("id", F.concat(F.lit("STT"), F.substring("sentence_id", 5, 20))).drop("sentence_id")
    noisy = noise.augment(samples)
    simple = (F.size("steps") == 0) | (F.array_join("steps", " ") == "hallucinations")
    return noisy.join(plan, noisy.sentence_id == plan.id).select(
        "sentence_id", "intent", "departure", "destination",
        F.when(simple & (F.col("intent") != "TRIP"), F.col("sentence")).alias("sentence"))


@query("light_augment", f"WITH {SAMPLES}, {noise_sql.LIGHT} SELECT {ALL} FROM light")
def light_augment(spark, sf):
    """K11."""
    return noise.augment_lightly(roles.samples(spark, sf), "sentence_id")


BROKEN = """broken AS (SELECT row_no, sentence_id, CASE WHEN row_no % 13 = 0 THEN ' ' ELSE sentence END AS sentence, CASE WHEN row_no % 17 = 0 THEN 'MAYBE' ELSE intent END AS intent,
  CASE WHEN row_no % 11 = 0 THEN '' ELSE departure END AS departure, CASE WHEN row_no % 19 = 0 THEN destination || ' X' WHEN row_no % 23 = 0 THEN 'y' ELSE destination END AS destination, intermediate FROM samples)"""


def broken(spark, sf):
    """Labelled sentences with planted faults."""
    k = F.substring("sentence_id", 5, 20).cast("bigint") - 1
    return roles.samples(spark, sf).withColumns({
        "sentence": F.when(k % 13 == 0, " ").otherwise(F.col("sentence")),
        "intent": F.when(k % 17 == 0, "MAYBE").otherwise(F.col("intent")),
        "departure": F.when(k % 11 == 0, "").otherwise(F.col("departure")),
        "destination": F.when(k % 19 == 0, F.concat("destination", F.lit(" X"))).when(k % 23 == 0, "y").otherwise(F.col("destination"))})


RULES = f"""{SAMPLES}, {BROKEN}, rules AS (
SELECT sentence_id, 'Invalid intent ''' || intent || '''' AS error FROM broken WHERE intent NOT IN ('TRIP', 'NOT_TRIP', 'NOT_FRENCH', 'UNKNOWN') UNION ALL
SELECT sentence_id, 'Empty sentence for non-UNKNOWN intent' FROM broken WHERE intent <> 'UNKNOWN' AND trim(sentence) = '' UNION ALL
SELECT sentence_id, 'TRIP missing departure' FROM broken WHERE intent = 'TRIP' AND departure = '' UNION ALL
SELECT sentence_id, 'TRIP missing destination' FROM broken WHERE intent = 'TRIP' AND destination = '' UNION ALL
SELECT sentence_id, intent || ' should not have departure/destination' FROM broken WHERE intent IN ('NOT_TRIP', 'NOT_FRENCH', 'UNKNOWN') AND (departure <> '' OR destination <> '')),
slotted AS (SELECT sentence_id, 'departure' AS slot, departure AS value FROM broken WHERE intent = 'TRIP' UNION ALL SELECT sentence_id, 'destination', destination FROM broken WHERE intent = 'TRIP'
  UNION ALL SELECT sentence_id, 'intermediate', intermediate FROM broken WHERE intent = 'TRIP'),
lost AS (SELECT * FROM slotted WHERE value <> '' AND value NOT IN (SELECT p_name FROM part))"""


@query("row_rules", f"WITH {RULES} SELECT sentence_id, error FROM rules")
def row_rules(spark, sf):
    """K14."""
    return validation.row_rules(broken(spark, sf))


@query("unknown_stations", f"WITH {RULES} SELECT sentence_id, slot, value FROM lost")
def unknown_stations(spark, sf):
    """D17, K13."""
    return validation.unknown_stations(broken(spark, sf), roles.places(spark, sf))


@query("set_verdict", f"""WITH {RULES} SELECT (SELECT count(*) FROM rules) AS schema_errors, (SELECT count(*) FROM lost) AS station_errors,
  (SELECT count(*) FROM rules) + (SELECT count(*) FROM lost) = 0 AS passed""")
def set_verdict(spark, sf):
    """K15."""
    return validation.verdict(broken(spark, sf), roles.places(spark, sf))


@query("length_issues", """SELECT doc_id, issue FROM (SELECT doc_id, 'Very long sentence (' || length(text) || ' chars)' AS issue FROM documents WHERE length(text) > 200
  UNION ALL SELECT doc_id, 'Very short sentence ''' || text || '''' FROM documents WHERE length(text) < 3) ORDER BY doc_id, issue LIMIT 20""")
def length_issues(spark, sf):
    """The first twenty issues (a report)."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence"), F.lit("TRIP").alias("intent"))
    return validation.length_issues(d, "doc_id")


@query("leak_check", """WITH v AS (SELECT 'documents' AS split, text AS value FROM documents UNION SELECT 'benchmark', text FROM benchmark
  UNION SELECT 'conversations', text FROM conversations UNION SELECT 'lines', unnest(string_split(text, E'\\n')) FROM documents)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM v a JOIN v b ON a.value = b.value AND a.split < b.split GROUP BY 1, 2""")
def leak_check(spark, sf):
    """H6: values that two sets share."""
    d, b, c = (table(spark, sf, t) for t in ("documents", "benchmark", "conversations"))

    def tagged(df, tag, value):
        return df.select(F.lit(tag).alias("split"), value.alias("value"))

    values = tagged(d, "documents", F.col("text")).union(tagged(b, "benchmark", F.col("text"))).union(
        tagged(c, "conversations", F.col("text"))).union(tagged(d, "lines", F.explode(F.split("text", "\n"))))
    return K.leak_check(values)


SHINGLES = """list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))"""


@query("shingle_leaks", f"""WITH d AS (SELECT doc_id, {token_sql('lower(text)')} AS w FROM documents), b AS (SELECT {token_sql('lower(text)')} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest({SHINGLES}) AS s FROM d), bs AS (SELECT DISTINCT unnest({SHINGLES}) AS s FROM b)
SELECT doc_id, count(*) AS shared FROM ds WHERE s IN (SELECT s FROM bs) GROUP BY 1""")
def shingle_leaks(spark, sf):
    """H6: documents that share five-word runs with the benchmark."""
    return K.shingle_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id")


@query("instruction_pairs", f"""WITH {SAMPLES} SELECT sentence_id, 'Extrais les villes: ' || sentence AS input,
  'DEPART: ' || coalesce(nullif(departure, ''), 'aucun') || ' | ARRIVEE: ' || coalesce(nullif(destination, ''), 'aucun') || ' | VIA: ' || coalesce(nullif(intermediate, ''), 'aucun') AS target FROM samples""")
def instruction_pairs(spark, sf):
    """J16."""
    return K.instruction_pairs(roles.samples(spark, sf))


MAPPED_LANGUAGE = "CASE WHEN language IN ('FRENCH', 'ENGLISH') THEN language ELSE 'UNKNOWN' END"


@query("samples_csv", f"WITH {SAMPLES} SELECT sentence, intent, {MAPPED_LANGUAGE} AS language, departure, destination, intermediate FROM samples")
def samples_csv(spark, sf):
    """Written as CSV and read back with mapped labels."""
    path = Stage(spark, "csv").root
    writers.write_samples_csv(roles.samples(spark, sf), path)
    return readers.samples_csv(spark, path)


@query("samples_json", f"WITH {SAMPLES} SELECT sentence_id, sentence, intent, {MAPPED_LANGUAGE} AS language, departure, destination, intermediate FROM samples")
def samples_json(spark, sf):
    """Written as JSON and read back; only the language is mapped."""
    path = Stage(spark, "json").root
    writers.write_json(roles.samples(spark, sf).repartition(4), path)
    return readers.samples_json(spark, path)
