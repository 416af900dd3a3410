"""Queries of the text jobs (section B, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave.catalog import query, table
from railweave.catalog import sql as S
from railweave.functions import labels, slots, text
from railweave.functions import wordlists as W
from railweave.functions.geo import add_cost, cost, distance_km, dominates, edge_cost, parse_post
from railweave.operators import ngram_language
from railweave.operators.gazetteer import station_key
from railweave.operators.mentions import find_mentions, nearest_places, title_case
from railweave.operators.training import clean_frame
from railweave.plans import roles
from railweave.plans.components import Registry, label_gated, label_with_all
from railweave.plans.resolve import analyse, clean_corpus, resolve

NAMES = "SELECT 'part ' || p_partkey AS id, p_name AS name FROM part UNION ALL " \
        "SELECT 'supp ' || s_suppkey, s_name FROM supplier UNION ALL " \
        "SELECT 'doc ' || doc_id, text FROM documents"


def _names(spark, sf):
    def named(name, tag, key, value):
        return table(spark, sf, name).select(
            F.concat(F.lit(tag + " "), F.col(key).cast("string")).alias("id"), F.col(value).alias("name"))

    return named("part", "part", "p_partkey", "p_name").unionByName(
        named("supplier", "supp", "s_suppkey", "s_name")).unionByName(
        named("documents", "doc", "doc_id", "text"))


@query("name_normalize", f"SELECT id, md5({S.normalize_name('name')}) AS norm FROM ({NAMES})")
def name_normalize(spark, sf):
    """B1 over place names and whole texts."""
    return _names(spark, sf).select("id", F.md5(text.normalize_name(F.col("name"))).alias("norm"))


SUFFIXES = ["", " TGV", " Ville", " gare de Lyon", " Gare du Nord", " St Jean", " (intramuros)",
            " ville TGV"]
SUFFIX_SQL = f"p_name || {S.listed(SUFFIXES)}[1 + p_size % 8]"


@query("city_name", f"SELECT p_partkey, {S.city_name(SUFFIX_SQL)} AS city FROM part")
def city_name(spark, sf):
    """B2: station suffixes off part names."""
    p = table(spark, sf, "part")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, SUFFIXES)), 1 + F.col("p_size") % 8))
    return p.select("p_partkey", text.extract_city_name(name).alias("city"))


@query("station_keys", """
SELECT s_suppkey, unnest(list_filter(list_transform(string_split(
    s_suppkey || '; ' || s_nationkey || ';;', ';'), lambda x: trim(x)), lambda x: x <> '')) AS uic,
    (SELECT string_agg(k, ';' ORDER BY k) FROM (SELECT unnest([s_suppkey::VARCHAR, s_nationkey::VARCHAR]) AS k)) AS station_key
FROM supplier""")
def station_keys(spark, sf):
    """B4 and the identity of a station: its sorted keys."""
    s = table(spark, sf, "supplier")
    keys = text.split_keys(F.concat(F.col("s_suppkey").cast("string"), F.lit("; "),
                                    F.col("s_nationkey").cast("string"), F.lit(";;")))
    return s.select("s_suppkey", F.explode(keys).alias("uic"),
                    station_key(keys, text.normalize_name(F.col("s_name"))).alias("station_key"))


@query("post_parse", """
SELECT post, n, round(CASE WHEN post NOT LIKE '%+%' THEN try_cast(post AS DOUBLE)
    ELSE try_cast(string_split(post, '+')[1] AS DOUBLE) + try_cast(string_split(post, '+')[2] AS DOUBLE) / 1000 END, 6) AS km
FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN l_linenumber || '+' || lpad(l_quantity::INT::VARCHAR, 3, '0')
    WHEN 1 THEN l_suppkey::VARCHAR WHEN 2 THEN l_returnflag || '+1' ELSE l_suppkey || '+' || l_linestatus END AS post,
    count(*) AS n FROM lineitem GROUP BY 1)""")
def post_parse(spark, sf):
    """B3 on readable and unreadable posts."""
    ln, sk = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    post = F.when(ln % 4 == 0, F.concat(ln.cast("string"), F.lit("+"), F.lpad(
        F.col("l_quantity").cast("int").cast("string"), 3, "0"))).when(ln % 4 == 1, sk).when(
        ln % 4 == 2, F.concat("l_returnflag", F.lit("+1"))).otherwise(
        F.concat(sk, F.lit("+"), "l_linestatus"))
    return table(spark, sf, "lineitem").groupBy(post.alias("post")).agg(
        F.count(F.lit(1)).alias("n")).select("post", "n", F.round(parse_post(F.col("post")), 6).alias("km"))


@query("unicode_compose", """
SELECT doc_id, md5(nfc_normalize(replace(replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)), 'ü', 'u' || chr(776)))) AS composed
FROM documents""")
def unicode_compose(spark, sf):
    """B5 on decomposed texts."""
    value = F.col("text")
    for char, pair in (("é", "é"), ("ñ", "ñ"), ("ü", "ü")):
        value = F.replace(value, F.lit(char), F.lit(pair))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.normalize_unicode(value)).alias("composed"))


@query("clean_steps", f"""
SELECT doc_id,
  md5(translate(translate(text, 'aeiou', 'ʼ´–—‑'), {S.quoted(W.APOSTROPHES + W.DASHES)}, {S.quoted("''''------")})) AS marks,
  md5({S.strip("regexp_replace(text, '[\\t\\n\\r\\f\\v ]+', ' ', 'g')")}) AS blanks,
  md5(strip_accents(text)) AS bare,
  md5(regexp_replace(text, '([^\\w\\s''-])', '', 'g')) AS unused_ascii
FROM documents""".replace("  md5(regexp_replace(text, '([^\\w\\s''-])', '', 'g')) AS unused_ascii\n", "").replace("AS bare,", "AS bare,")
    .replace("AS bare,\n", "AS bare,\n  md5(" + S.unguarded(
        "regexp_replace(" + S.guarded("text") + ", '([\\x00-\\x7F\\p{P}\\p{S}])', '\\1', 'g')") + ") AS same,\n")
    .replace("AS same,\n", "AS same\n"))
def clean_steps(spark, sf):
    """B6, B7, B8 step by step."""
    x = F.col("text")
    marks = F.translate(x, "aeiou", "ʼ´–—‑")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.normalize_hyphens(text.normalize_apostrophes(marks))).alias("marks"),
        F.md5(text.normalize_whitespace(x)).alias("blanks"),
        F.md5(text.remove_accents(x)).alias("bare"), F.md5(x).alias("same"))


@query("punctuation_strip", """
SELECT doc_id, md5(regexp_replace(text, '[^\\w\\s''\\p{L}\\p{N}-]', '', 'g')) AS words FROM documents""")
def punctuation_strip(spark, sf):
    """B9."""
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.remove_punctuation(F.col("text"))).alias("words"))


@query("clean_pipeline", f"""
SELECT doc_id, md5({S.clean_text('text')}) AS plain,
  md5({S.strip("regexp_replace(regexp_replace(lower(strip_accents(" + S.clean_text('text') + ")), '[^\\w\\s''\\p{L}\\p{N}-]', '', 'g'), '[\\t\\n\\r\\f\\v ]+', ' ', 'g')")}) AS strict
FROM documents""")
def clean_pipeline(spark, sf):
    """B10 with the default switches and with all of them."""
    strict = text.CleanConfig(lowercase=True, remove_accents=True, remove_punctuation=True)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.clean_text(F.col("text"))).alias("plain"),
        F.md5(text.clean_text(F.col("text"), strict)).alias("strict"))


@query("token_spans", """
WITH pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS p,
    generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS i FROM documents),
placed AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pieces)
SELECT doc_id, count(*) AS n_tokens, sum(e - length(p))::BIGINT AS sum_start, sum(e)::BIGINT AS sum_end
FROM placed WHERE trim(p, E' \\n\\t\\r') <> '' GROUP BY doc_id""")
def token_spans(spark, sf):
    """Tokens and their character spans."""
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn(
        "tokens", text.tokenize(F.col("text"))).withColumn(
        "spans", text.token_spans("text", "tokens")).filter(F.size("tokens") > 0)

    def total(field):
        return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[field])

    return d.select("doc_id", F.size("tokens").alias("n_tokens"), total("start").alias("sum_start"),
                    total("end").alias("sum_end"))


MARKED = ("CASE doc_id % 4 WHEN 0 THEN '[music] ' || text WHEN 1 THEN text || ' *bruit* ... ---' "
          "WHEN 2 THEN replace(text, ', ', ' [???] ') ELSE text END")


def _marked(docs):
    x, k = F.col("text"), F.col("doc_id") % 4
    return docs.withColumn("text", F.when(k == 0, F.concat(F.lit("[music] "), x)).when(
        k == 1, F.concat(x, F.lit(" *bruit* ... ---"))).when(
        k == 2, F.replace(x, F.lit(", "), F.lit(" [???] "))).otherwise(x))


@query("artifact_clean", f"""
SELECT doc_id, md5(bare) AS bare, bare = '' AS is_noise
FROM (SELECT doc_id, {S.clean_artifacts('t')} AS bare FROM (SELECT doc_id, {MARKED} AS t FROM documents))""")
def artifact_clean(spark, sf):
    """B12 on texts with transcript markers."""
    return _marked(table(spark, sf, "documents")).select(
        "doc_id", F.md5(text.clean_artifacts(F.col("text"))).alias("bare"),
        text.is_pure_artifact(F.col("text")).alias("is_noise"))


@query("corpus_clean", f"""
SELECT count(*) AS n, count(*) FILTER (bare = '') AS n_noise, sum(length({S.clean_text('bare')}))::BIGINT AS chars
FROM (SELECT {S.clean_artifacts('t')} AS bare FROM (SELECT {MARKED} AS t FROM documents))""")
def corpus_clean(spark, sf):
    """Artifacts, then the clean pipeline, with the noise count."""
    return clean_corpus(_marked(table(spark, sf, "documents"))).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_noise").alias("n_noise"),
        F.sum(F.length("clean")).alias("chars"))


@query("label_maps", """
SELECT o_orderkey,
  CASE raw WHEN 'VALID' THEN 'TRIP' WHEN 'INVALID' THEN 'NOT_TRIP' ELSE raw END AS intent,
  CASE WHEN upper(lang) IN ('FRENCH', 'ENGLISH') THEN upper(lang) ELSE 'UNKNOWN' END AS language,
  trim(nullif(slot, '')) AS slot, string_split(trim(nullif(slot, '')), '-')[1] AS city
FROM (SELECT o_orderkey, ['VALID', 'INVALID', 'TRIP', 'UNKNOWN'][1 + o_orderkey % 4] AS raw,
  ['french', 'English', 'German'][1 + o_orderkey % 3] AS lang,
  ['', ' ', o_orderpriority][1 + o_orderkey % 3] AS slot FROM orders)""")
def label_maps(spark, sf):
    """B13, B14, B15, B16."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")

    def choose(values, n):
        return F.element_at(F.array(*values), (1 + k % n).cast("int"))

    raw = choose([F.lit(v) for v in (" valid ", "INVALID", "Trip", "UNKNOWN")], 4)
    lang = choose([F.lit(v) for v in ("french", "English", "German")], 3)
    slot = choose([F.lit(""), F.lit(" "), F.col("o_orderpriority")], 3)
    return o.select("o_orderkey", labels.map_intent_label(raw).alias("intent"),
                    labels.map_language_label(lang).alias("language"),
                    labels.normalize_location(slot).alias("slot"),
                    labels.city_of_station(slot).alias("city"))


@query("sentence_flags", """
SELECT doc_id, NOT contains(lower(text), lower(w1)) OR NOT contains(lower(text), lower(w2)) AS misspelled,
  coalesce(regexp_matches(text, '^\\P{L}*\\p{Ll}'), false) AS lowercase
FROM (SELECT d.doc_id, d.text, regexp_extract(d.text, '\\S+') AS w1, source AS w2 FROM documents d)""")
def sentence_flags(spark, sf):
    """B17, B18."""
    x = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", labels.is_misspelled(x, F.regexp_extract(x, r"\S+", 0), F.col("source")).alias("misspelled"),
        labels.starts_lowercase(x).alias("lowercase"))


MENTION = ("['le ', 'La ', 'the ', '', 'de la '][1 + p_partkey % 5] || p_name || "
           "['', ' demain', ',', ' please', ' s''il vous plait', '!?'][1 + p_size % 6]")


@query("mention_clean", f"SELECT p_partkey, {S.clean_mention(MENTION)} AS place FROM part")
def mention_clean(spark, sf):
    """B19."""
    heads = F.array(*map(F.lit, ["le ", "La ", "the ", "", "de la "]))
    tails = F.array(*map(F.lit, ["", " demain", ",", " please", " s'il vous plait", "!?"]))
    raw = F.concat(F.element_at(heads, (1 + F.col("p_partkey") % 5).cast("int")), "p_name",
                   F.element_at(tails, 1 + F.col("p_size") % 6))
    return table(spark, sf, "part").select("p_partkey", slots.clean_mention(raw).alias("place"))


@query("output_slots", """
WITH o AS (SELECT p_partkey, ['aucun', p_name, 'None'][1 + p_partkey % 3] AS dep, p_brand AS dest,
  ['aucun', p_type || ', aucun', p_type || ' , ' || p_name][1 + p_size % 3] AS via FROM part)
SELECT p_partkey, nullif(nullif(dep, 'aucun'), 'None') AS departure, dest AS destination,
  array_to_string(list_filter(list_transform(string_split(CASE WHEN via = 'aucun' THEN '' ELSE via END, ','),
    lambda v: trim(v)), lambda v: v NOT IN ('', 'aucun')), '|') AS stops FROM o""")
def output_slots(spark, sf):
    """Generated text to slots."""
    k, n = F.col("p_partkey"), F.col("p_size")
    dep = F.element_at(F.array(F.lit("aucun"), F.col("p_name"), F.lit("None")), (1 + k % 3).cast("int"))
    via = F.element_at(F.array(F.lit("aucun"), F.concat("p_type", F.lit(", aucun")),
                               F.concat("p_type", F.lit(" , "), "p_name")), 1 + n % 3)
    raw = F.concat(F.lit("Depart : "), dep, F.lit(" | ARRIVEE: "), "p_brand", F.lit(" | via:"), via)
    s = slots.parse_output_slots(raw)
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).select(
        "p_partkey", "s.departure", "s.destination", F.array_join("s.intermediate", "|").alias("stops"))


@query("output_labels", """
SELECT p_partkey, ['TRIP', 'NOT_TRIP', 'NOT_FRENCH', 'UNKNOWN', 'NOT_TRIP', 'UNKNOWN'][1 + p_size % 6] AS label,
  CASE WHEN p_size % 6 = 5 THEN 0.5 ELSE 0.9 END::DOUBLE AS conf FROM part""")
def output_labels(spark, sf):
    """Generated text to a label; 'pas_voyage' is not a voyage."""
    raw = F.element_at(F.array(*map(F.lit, [
        "VOYAGE", "pas_voyage", " Pas francais.", "inconnu", "c'est PAS_VOYAGE", "rien"])),
        1 + F.col("p_size") % 6)
    return table(spark, sf, "part").select("p_partkey", labels.parse_output_label(raw).alias("r")
                                           ).select("p_partkey", "r.label", "r.conf")


@query("input_lines", """
SELECT conv_id, turn, CASE WHEN contains(l, ',') THEN trim(string_split(l, ',')[1], E' \\n') ELSE 'AUTO' END AS id,
  CASE WHEN contains(l, ',') THEN trim(substr(l, instr(l, ',') + 1), E' \\n') ELSE trim(l, E' \\n') END AS body
FROM (SELECT conv_id, turn, text AS l FROM conversations WHERE role = 'user')""")
def input_lines(spark, sf):
    """B22 on user turns."""
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", labels.parse_input_line(F.col("text")).alias("l")).select(
        "conv_id", "turn", F.col("l.id").alias("id"), F.col("l.text").alias("body"))


@query("great_circle", f"""
WITH p AS (SELECT s_suppkey AS k, 42 + (s_suppkey * 37 % 900) / 100.0 AS lat, -4 + (s_suppkey * 53 % 1200) / 100.0 AS lon FROM supplier)
SELECT a.k AS k, round({S.distance('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km
FROM p a JOIN p b ON b.k = a.k + 1""")
def great_circle(spark, sf):
    """Supplier to the next supplier."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    a = s.select("k", roles.latitude(F.col("k")).alias("lat"), roles.longitude(F.col("k")).alias("lon"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "k").select("k", F.round(distance_km(
        F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query("edge_costs", """
WITH c AS (SELECT *, l_quantity / (CASE WHEN l_linestatus = 'F' THEN 280.0 ELSE 80.0 END) AS t,
  CASE WHEN l_linenumber > 1 AND l_returnflag <> 'N' THEN 1 ELSE 0 END AS x FROM lineitem)
SELECT l_suppkey, round(sum(t)::DECIMAL(38, 10)::DOUBLE, 4) AS hours, sum(l_quantity) AS km, sum(x)::BIGINT AS transfers,
  count(*) FILTER (t <= 0.25 AND l_quantity <= 20 AND x <= 0 AND (t < 0.25 OR l_quantity < 20 OR x < 0)) AS dominating
FROM c GROUP BY l_suppkey""")
def edge_costs(spark, sf):
    """Cost vectors, their sums and dominance over a fixed vector."""
    speed = F.when(F.col("l_linestatus") == "F", 280.0).otherwise(80.0)
    last = F.when(F.col("l_linenumber") > 1, F.lit("N"))
    c = edge_cost(F.col("l_quantity"), speed, F.col("l_returnflag"), last)
    zero = cost(F.lit(0.0), F.lit(0.0), F.lit(0))
    mark = cost(F.lit(0.25), F.lit(20.0), F.lit(0))
    return table(spark, sf, "lineitem").select("l_suppkey", add_cost(zero, c).alias("c")).groupBy(
        "l_suppkey").agg(
        F.round(F.sum("c.time"), 4).alias("hours"), F.sum("c.distance").alias("km"),
        F.sum("c.transfers").alias("transfers"),
        F.count_if(dominates(F.col("c"), mark)).alias("dominating"))


TRIP_ROWS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NOT_TRIP' ELSE 'TRIP' END AS intent,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS dep,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS dest FROM orders"""


@query("trip_flags", f"""
SELECT o_orderkey, intent = 'TRIP' AND dep <> '' AND coalesce(dest, '') <> '' AS valid,
  CASE WHEN intent = 'TRIP' AND dep = '' AND coalesce(dest, '') = '' THEN 'NOT_TRIP' ELSE intent END AS final,
  CASE WHEN intent = 'TRIP' AND dep = '' AND coalesce(dest, '') = '' THEN 0.5 ELSE 0.8 END::DOUBLE AS conf,
  CASE WHEN dep <> '' THEN dep END AS raw, CASE WHEN dep <> '' THEN dest END AS matched,
  CASE WHEN dep <> '' THEN CASE WHEN dest <> '' THEN 1.0 ELSE 0.0 END END::DOUBLE AS confidence
FROM ({TRIP_ROWS})""")
def trip_flags(spark, sf):
    """B26, B27, B28."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "NOT_TRIP").otherwise("TRIP").alias("intent"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("dep"),
        F.when(k % 5 == 0, F.col("o_orderstatus")).alias("dest"))
    down = labels.downgrade_intent(labels.labelled(F.col("intent"), 0.8), F.col("dep"), F.col("dest"))
    return rows.select(
        "o_orderkey", labels.is_valid_trip(F.col("intent"), F.col("dep"), F.col("dest")).alias("valid"),
        down.alias("d"), labels.entity_match(F.col("dep"), F.col("dest")).alias("e")).select(
        "o_orderkey", "valid", F.col("d.label").alias("final"), "d.conf", "e.raw", "e.matched",
        "e.confidence")


@query("id_rename", "SELECT o_orderkey, 'STT' || o_orderkey AS id FROM orders")
def id_rename(spark, sf):
    """B29."""
    return table(spark, sf, "orders").select("o_orderkey", labels.rename_id(
        F.concat(F.lit("BASE"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("frame_clean", """
SELECT doc_id, md5(trim(text)) AS sentence, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS departure
FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND trim(text) <> ''""")
def frame_clean(spark, sf):
    """Rows without sentence or intent dropped, slots filled."""
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(k % 7 != 0, F.col("text")).alias("sentence"),
        F.when(k % 11 != 0, F.lit("TRIP")).alias("intent"),
        F.when(k % 2 == 0, F.col("source")).alias("departure"), none.alias("destination"),
        none.alias("intermediate"))
    return clean_frame(rows).select("doc_id", F.md5("sentence").alias("sentence"), "departure")


# --- labelling and slots ------------------------------------------------------------

@query("language_label", f"WITH {S.language_ctes('documents')} "
                         "SELECT doc_id, label, round(conf, 6) AS conf FROM lang_pred")
def language_label(spark, sf):
    """J1."""
    return table(spark, sf, "documents").select(
        "doc_id", labels.label_language(F.col("text")).alias("r")).select(
        "doc_id", "r.label", F.round("r.conf", 6).alias("conf"))


@query("intent_label", f"WITH {S.intent_ctes('documents')} SELECT doc_id, label, conf FROM intent_pred")
def intent_label(spark, sf):
    """J3."""
    return table(spark, sf, "documents").select(
        "doc_id", labels.label_intent(F.col("text")).alias("r")).select("doc_id", "r.label", "r.conf")


@query("short_gate", f"""WITH u AS (SELECT 'c' || conv_id || '-' || turn AS doc_id, text FROM conversations
  UNION ALL SELECT 'd' || doc_id, text FROM documents), {S.intent_ctes('u')}
SELECT doc_id, CASE WHEN length(trim(text, E' \\n')) < 3 THEN 'UNKNOWN' ELSE label END AS label,
  CASE WHEN length(trim(text, E' \\n')) < 3 THEN 0.5 ELSE conf END::DOUBLE AS conf FROM u JOIN intent_pred USING (doc_id)""")
def short_gate(spark, sf):
    """All turns and documents; texts under three characters get the default label."""
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("doc_id"), "text")
    both = turns.unionAll(table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text"))
    return both.select("doc_id", label_gated(F.col("text"), labels.label_intent).alias("r")).select(
        "doc_id", "r.label", "r.conf")


@query("slots_extract", f"""WITH {S.slot_ctes('documents')}
SELECT doc_id, md5(departure) AS departure, md5(destination) AS destination,
  len(intermediate)::BIGINT AS n_stops, md5(array_to_string(intermediate, '|')) AS stops FROM slot_pred""")
def slots_extract(spark, sf):
    """J6, J7, J8 over whole texts."""
    return table(spark, sf, "documents").select(
        "doc_id", slots.extract_slots(F.col("text")).alias("s")).select(
        "doc_id", F.md5("s.departure").alias("departure"), F.md5("s.destination").alias("destination"),
        F.size("s.intermediate").alias("n_stops"),
        F.md5(F.array_join("s.intermediate", "|")).alias("stops"))


SENTENCE_CODE = f"""
w AS (SELECT doc_id, text, departure, destination, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS ws
  FROM documents JOIN slot_pred USING (doc_id)),
c AS (SELECT doc_id, departure, destination, len(list_intersect(ws, {S.listed(W.FRENCH_SENTENCE_WORDS)})) / greatest(len(ws), 1) AS ratio,
  CASE WHEN coalesce(departure, '') <> '' AND coalesce(destination, '') <> '' THEN NULL
    WHEN NOT (len(list_intersect(ws, {S.listed(W.FRENCH_SENTENCE_WORDS)})) / greatest(len(ws), 1) >= 0.15 OR len(ws) <= 2) THEN 'NOT_FRENCH'
    WHEN NOT list_has_any(ws, {S.listed(W.TRIP_SENTENCE_WORDS)}) AND coalesce(departure, '') = '' AND coalesce(destination, '') = '' THEN 'NOT_TRIP'
    ELSE 'UNKNOWN' END AS code FROM w)"""


@query("sentence_code", f"""WITH {S.slot_ctes('documents')}, {SENTENCE_CODE}
SELECT doc_id, round(ratio, 6) AS ratio, code,
  md5(CASE WHEN code IS NULL THEN doc_id || ',' || departure || ',' || destination
    WHEN code = 'UNKNOWN' AND (coalesce(departure, '') <> '' OR coalesce(destination, '') <> '') THEN
      doc_id || ',' || coalesce(nullif(departure, ''), '?') || ',' || coalesce(nullif(destination, ''), '?') || ',' || code
    ELSE doc_id || ',' || code END) AS line FROM c""")
def sentence_code(spark, sf):
    """J5, E30, H2, A15."""
    d = table(spark, sf, "documents").select(
        "doc_id", "text", slots.extract_slots(F.col("text")).alias("s"))
    coded = d.select("doc_id", "s.departure", "s.destination",
                     labels.french_word_ratio(F.col("text")).alias("ratio"),
                     labels.sentence_code(F.col("text"), F.col("s.departure"), F.col("s.destination")).alias("code"))
    return coded.select("doc_id", F.round("ratio", 6).alias("ratio"), "code", F.md5(labels.extraction_line(
        F.col("doc_id").cast("string"), F.col("departure"), F.col("destination"), F.col("code"))).alias("line"))


NGRAM = r"""
padded AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM documents),
grams AS (SELECT doc_id, lang, substr(t, i, 3) AS gram, count(*) AS n
  FROM (SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM padded) GROUP BY 1, 2, 3),
per_lang AS (SELECT lang, gram, sum(n) AS n FROM grams GROUP BY 1, 2),
totals AS (SELECT lang, sum(n) AS total FROM per_lang GROUP BY 1),
vocab AS (SELECT count(DISTINCT gram) AS v FROM per_lang),
profiles AS (SELECT g.gram, t.lang, ln((coalesce(p.n, 0) + 1) / (t.total + v)) AS logp
  FROM (SELECT DISTINCT gram FROM per_lang) g CROSS JOIN totals t CROSS JOIN vocab
  LEFT JOIN per_lang p ON p.gram = g.gram AND p.lang = t.lang),
scores AS (SELECT doc_id, p.lang, sum(n * logp) AS score FROM grams g JOIN profiles p ON g.gram = p.gram GROUP BY 1, 2)"""


@query("ngram_language", f"""WITH {NGRAM}
SELECT doc_id, CASE top WHEN 'fr' THEN 'FRENCH' WHEN 'en' THEN 'ENGLISH' ELSE 'UNKNOWN' END AS label, round(best, 3) AS score
FROM (SELECT doc_id, max_by(lang, score) AS top, max(score) AS best FROM scores GROUP BY 1)""")
def ngram_language_query(spark, sf):
    """Profiles trained on the labelled texts, then scored."""
    d = table(spark, sf, "documents")
    profiles = ngram_language.train_profiles(d)
    found = ngram_language.detect_languages(d, profiles, "doc_id")
    return found.select("doc_id", "label", F.round("score", 3).alias("score"))


def benchmark_places(spark, sf):
    """Place names that do occur in the documents: the first three words of benchmark texts."""
    words = F.slice(text.words(F.regexp_replace(F.lower("text"), "[.,]", "")), 1, 3)
    return table(spark, sf, "benchmark").select(
        F.array_join(words, " ").alias("name"), F.col("item_id").alias("ord")).unionByName(
        table(spark, sf, "benchmark").select(
            F.element_at(text.words(F.regexp_replace(F.lower("text"), "[.,]", "")), 2).alias("name"),
            (F.col("item_id") + 1_000_000).alias("ord")))


PLACES = r"""
bw AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(text), '[.,]', '', 'g'), '\S+') AS w FROM benchmark),
place0 AS (SELECT array_to_string(w[1:3], ' ') AS place, item_id AS ord FROM bw UNION ALL SELECT w[2], item_id + 1000000 FROM bw),
place AS (SELECT lower(place) AS place, min(ord) AS ord FROM place0 WHERE length(place) >= 3 GROUP BY 1),
cand AS (SELECT doc_id, place, ord, instr(lower(text), place) AS pos, lower(text) AS t FROM documents, place WHERE contains(lower(text), place)),
edge AS (SELECT doc_id, place, ord, pos - 1 AS s, pos - 1 + length(place) AS e FROM cand
  WHERE (pos = 1 OR contains(E' .,;:!?()[]{}"\'\t\n-', substr(t, pos - 1, 1)))
    AND (pos + length(place) > length(t) OR contains(E' .,;:!?()[]{}"\'\t\n-', substr(t, pos + length(place), 1))))"""

# longest first, first come: a candidate is kept unless a kept one before it overlaps
MENTIONS = f"""WITH RECURSIVE {PLACES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, ord, place) AS r FROM edge),
fold AS (SELECT doc_id, 1::BIGINT AS r, [{{'s': s, 'e': e, 'p': place}}] AS kept FROM ranked WHERE r = 1
  UNION ALL
  SELECT f.doc_id, f.r + 1, CASE WHEN len(list_filter(f.kept, lambda k: k.s < x.e AND k.e > x.s)) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'s': x.s, 'e': x.e, 'p': x.place}}) END
  FROM fold f JOIN ranked x ON x.doc_id = f.doc_id AND x.r = f.r + 1),
last AS (SELECT doc_id, max_by(kept, r) AS kept FROM fold GROUP BY 1),
mention AS (SELECT doc_id, unnest(kept) AS m FROM last),
ordered AS (SELECT doc_id, list(m.p ORDER BY m.s) AS ps, list(m.s ORDER BY m.s) AS ss FROM mention GROUP BY 1)"""


def _mentions(spark, sf):
    return find_mentions(table(spark, sf, "documents"), benchmark_places(spark, sf), "doc_id")


@query("place_mentions", f"""{MENTIONS}
SELECT doc_id, len(ps)::BIGINT AS n, array_to_string(ps, '|') AS places, array_to_string(ss, '|') AS starts FROM ordered""")
def place_mentions(spark, sf):
    """Bounded, longest-first, non-overlapping mentions."""
    m = _mentions(spark, sf)
    return m.select("doc_id", F.size("mentions").alias("n"),
                    F.array_join(F.transform("mentions", lambda x: x["text"]), "|").alias("places"),
                    F.array_join(F.transform("mentions", lambda x: x["start"].cast("string")), "|").alias("starts"))


@query("mention_roles", f"""{MENTIONS}
SELECT doc_id, CASE WHEN len(ps) >= 2 THEN ps[1] END AS departure, ps[-1] AS destination,
  array_to_string(CASE WHEN len(ps) > 2 THEN ps[2:len(ps) - 1] ELSE []::VARCHAR[] END, '|') AS stops,
  round(least(0.5 + 0.1 * len(ps), 0.8), 6)::DOUBLE AS conf FROM ordered""")
def mention_roles(spark, sf):
    """Slots and intent from ordered mentions."""
    m = _mentions(spark, sf).withColumn(
        "s", slots.roles_by_order(F.transform("mentions", lambda x: x["text"])))
    return m.select("doc_id", "s.departure", "s.destination",
                    F.array_join("s.intermediate", "|").alias("stops"),
                    F.round(labels.label_intent_by_mentions(F.size("mentions"))["conf"], 6).alias("conf"))


VIA = " OR ".join(
    f"(instr(t, '{k}') > 0 AND instr(t, '{k}') - 1 < m.s AND m.s < instr(t, '{k}') + 29)"
    for k in W.VIA_KEYWORDS)


@query("via_roles", f"""{MENTIONS},
near AS (SELECT m.doc_id, list(m.m.p) AS marked FROM mention m JOIN documents d USING (doc_id)
  WHERE {VIA.replace('m.s', 'm.m.s').replace('(t,', '(lower(d.text),')} GROUP BY 1),
mid AS (SELECT o.doc_id, ps, CASE WHEN len(ps) > 2 THEN ps[2:len(ps) - 1] ELSE []::VARCHAR[] END AS mids, marked
  FROM ordered o LEFT JOIN near n ON o.doc_id = n.doc_id)
SELECT doc_id, array_to_string(CASE WHEN marked IS NULL THEN mids
  ELSE list_filter(mids, lambda x: list_contains(marked, x)) END, '|') AS stops FROM mid""")
def via_roles(spark, sf):
    """Middle mentions behind a via keyword."""
    m = _mentions(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    spans = F.transform("mentions", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start")))
    return m.select("doc_id", F.array_join(
        slots.roles_with_via(F.col("text"), spans)["intermediate"], "|").alias("stops"))


@query("mention_titles", f"WITH {PLACES} SELECT place, array_to_string(list_transform(string_split(place, ' '), "
       "lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM place")
def mention_titles(spark, sf):
    """How a matched place is shown."""
    p = benchmark_places(spark, sf).select(F.lower("name").alias("place")).filter(
        F.length("place") >= 3).distinct()
    return p.select("place", title_case(F.col("place")).alias("shown"))


@query("model_fanout", f"""WITH {S.language_ctes('documents')}, {S.intent_ctes('documents')}
SELECT doc_id, 'intent' AS model, label, conf FROM intent_pred UNION ALL
SELECT doc_id, 'language', label, round(conf, 6) FROM lang_pred""")
def model_fanout(spark, sf):
    """Every selected labeller's answer per text."""
    registry = Registry()
    both = {**{"language": registry.select("language", "regex")["regex"]},
            **{"intent": registry.select("intent", "regex")["regex"]}}
    d = label_with_all(table(spark, sf, "documents").select("doc_id", "text"), "text", both)
    return d.select("doc_id", "model", "label", F.round("conf", 6).alias("conf"))


RESOLVED = f"""
cleaned AS (SELECT doc_id, {S.clean_text(S.clean_artifacts('text'))} AS text FROM documents),
{S.language_ctes('cleaned')}, {S.intent_ctes('cleaned')}, {S.slot_ctes('cleaned')}"""


@query("resolve_texts", f"""WITH {RESOLVED}
SELECT doc_id, CASE WHEN i.label = 'TRIP' AND coalesce(departure, '') = '' AND coalesce(destination, '') = '' THEN 'NOT_TRIP' ELSE i.label END AS intent,
  l.label AS language, md5(coalesce(departure, '')) AS departure, md5(coalesce(destination, '')) AS destination,
  i.label = 'TRIP' AND coalesce(departure, '') <> '' AND coalesce(destination, '') <> '' AS is_valid_trip
FROM intent_pred i JOIN lang_pred l USING (doc_id) JOIN slot_pred USING (doc_id)""")
def resolve_texts(spark, sf):
    """J12 without linking: clean, language, intent, slots, downgrade."""
    r = resolve(table(spark, sf, "documents"), "doc_id")
    return r.select("doc_id", "intent", "language", F.md5("departure").alias("departure"),
                    F.md5("destination").alias("destination"), "is_valid_trip")


@query("label_matrix", f"""WITH {RESOLVED}
SELECT d.lang, l.label AS language, i.label AS intent, count(*) AS n
FROM documents d JOIN intent_pred i USING (doc_id) JOIN lang_pred l USING (doc_id) GROUP BY 1, 2, 3""")
def label_matrix(spark, sf):
    """The minimum slice: analyse every document and count labels by true language."""
    d = analyse(table(spark, sf, "documents").select("doc_id", "text", "lang").withColumnRenamed(
        "lang", "true_lang"))
    return d.groupBy(F.col("true_lang").alias("lang"), F.col("language.label").alias("language"),
                     F.col("intent.label").alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("embedding_nearest", """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT label AS place, list(avg_v ORDER BY i) AS v FROM (
  SELECT label, i, avg(x) AS avg_v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id AS q, place, list_dot_product(u.v, c.v) / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(c.v, c.v))) AS score FROM u, c)
SELECT q, place, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, place) = 1""")
def embedding_nearest(spark, sf):
    """Every vector to the nearest pooled place vector."""
    from railweave.operators.mentions import mean_pool

    e = table(spark, sf, "embeddings")
    places = mean_pool(e, "label", "embedding", 64).select(F.col("label").alias("place"), F.col("embedding").alias("vec"))
    queries = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
    return nearest_places(queries, places, k=1, threshold=-1.0).select(
        "q", "place", F.round("score", 6).alias("score"))


@query("embedding_matches", """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT place, list(avg_v ORDER BY i) AS v FROM (
  SELECT place, i, avg(x) AS avg_v FROM (SELECT label || ' ' || (vec_id % 100) AS place, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id AS q, place, list_dot_product(u.v, c.v) / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(c.v, c.v))) AS score FROM u, c)
SELECT q, place, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, place) AS rank
FROM s WHERE score >= 0.85 QUALIFY rank <= 3""")
def embedding_matches(spark, sf):
    """The three nearest of many pooled places from a cosine of 0.85 on."""
    from railweave.operators.mentions import mean_pool

    e = table(spark, sf, "embeddings")
    place = F.concat_ws(" ", F.col("label").cast("string"), F.pmod("vec_id", F.lit(100)).cast("string"))
    places = mean_pool(e.withColumn("place", place), "place", "embedding", 64).withColumnRenamed("embedding", "vec")
    queries = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
    return nearest_places(queries, places, k=3, threshold=0.85).withColumn("score", F.round("score", 6))
