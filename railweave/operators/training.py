"""Training-set jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions.bio import blank_labels, label_exact
from railweave.functions.text import bind, words
from railweave.operators.noise import augment_lightly
from railweave.operators.scale import hash_bucket, hash_int, hash_key, number_rows, uniform

# Own sentence patterns per (intent, language, kind); any other table of the same
# columns may be passed in.
TEMPLATES = [
    ("TRIP", "FRENCH", "regular", "Je veux aller de {dep} a {dest}"),
    ("TRIP", "FRENCH", "regular", "Un billet {dep} vers {dest} demain"),
    ("TRIP", "FRENCH", "regular", "Quel train pour {dest}"),
    ("TRIP", "FRENCH", "minimal", "{dep} {dest}"),
    ("TRIP", "FRENCH", "intermediate", "De {dep} a {dest} en passant par {via}"),
    ("TRIP", "FRENCH", "truncated", "Je veux aller de {dep} a {dest} avec"),
    ("TRIP", "ENGLISH", "regular", "I want to go from {dep} to {dest}"),
    ("TRIP", "ENGLISH", "intermediate", "From {dep} to {dest} via {via}"),
    ("TRIP", "SPANISH", "regular", "Quiero ir desde {dep} hasta {dest}"),
    ("TRIP", "SPANISH", "intermediate", "Desde {dep} hasta {dest} por {via}"),
    ("TRIP", "GERMAN", "regular", "Ich will von {dep} nach {dest} fahren"),
    ("TRIP", "GERMAN", "intermediate", "Von {dep} nach {dest} ueber {via}"),
    ("TRIP", "ITALIAN", "regular", "Vorrei andare da {dep} a {dest}"),
    ("TRIP", "ITALIAN", "intermediate", "Da {dep} a {dest} via {via}"),
    ("TRIP", "MIXED", "regular", "I want aller de {dep} to {dest}"),
    ("NOT_TRIP", "FRENCH", "regular", "La gare de {dest} est tres belle"),
    ("NOT_TRIP", "FRENCH", "regular", "Il fait froid ce matin"),
    ("NOT_TRIP", "ENGLISH", "regular", "The weather is nice today"),
    ("NOT_TRIP", "SPANISH", "regular", "Hace mucho calor hoy"),
    ("NOT_TRIP", "GERMAN", "regular", "Das Wetter ist heute gut"),
    ("NOT_TRIP", "ITALIAN", "regular", "Oggi fa molto caldo"),
    ("UNKNOWN", "UNKNOWN", "regular", "xk qz ## pfff"),
]
TEMPLATE_SCHEMA = "intent string, language string, kind string, template string"
SAMPLE_COLUMNS = ["sentence_id", "sentence", "intent", "language", "departure", "destination",
                  "intermediate"]

# Shares of the generated set (floors; the last of each level takes the rest).
INTENT_SHARES = [("TRIP", 0.74), ("NOT_TRIP", 0.25), ("UNKNOWN", None)]
TRIP_SHARES = [("FRENCH", 0.90), ("ENGLISH", 0.06), ("SPANISH", 0.01), ("GERMAN", 0.01),
               ("ITALIAN", 0.005), ("MIXED", None)]
NOT_TRIP_SHARES = [("FRENCH", 0.90), ("ENGLISH", 0.08), ("SPANISH", 0.005), ("GERMAN", 0.005),
                   ("ITALIAN", None)]
TRUNCATED_SHARE, MINIMAL_SHARE = 0.01, 0.10


def template_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or TEMPLATES, TEMPLATE_SCHEMA)


def _parts(total: int, shares) -> list[tuple[str, int]]:
    counts = [(name, int(total * share)) for name, share in shares if share is not None]
    rest = [name for name, share in shares if share is None]
    return counts + [(name, total - sum(n for _, n in counts)) for name in rest]


def quota_plan(spark: SparkSession, total: int, intermediate_ratio: float = 0.15) -> DataFrame:
    """K2: (intent, language, kind, n, start, end): cumulative ranges over row numbers.

    A few rows whatever the total, so they are built in place.
    """
    rows = []
    for intent, n in _parts(total, INTENT_SHARES):
        if intent == "UNKNOWN":
            rows.append((intent, "UNKNOWN", "regular", n))
            continue
        for language, m in _parts(n, TRIP_SHARES if intent == "TRIP" else NOT_TRIP_SHARES):
            if intent == "NOT_TRIP" or language == "MIXED":
                rows.append((intent, language, "regular", m))
                continue
            stops = int(m * intermediate_ratio)
            cut = int(m * TRUNCATED_SHARE) if language == "FRENCH" else 0
            small = int(m * MINIMAL_SHARE) if language == "FRENCH" else 0
            rows += [(intent, language, "regular", m - stops - cut - small),
                     (intent, language, "minimal", small), (intent, language, "intermediate", stops),
                     (intent, language, "truncated", cut)]
    begin, table = 0, []
    for intent, language, kind, n in rows:
        if n:
            table.append((intent, language, kind, n, begin, begin + n))
            begin += n
    return spark.createDataFrame(
        table, "intent string, language string, kind string, n bigint, start bigint, end bigint")


def planned_rows(rows: DataFrame, plan: DataFrame, number: str = "row_no") -> DataFrame:
    """K2: give every numbered row (0-based) the cell of the plan that covers its number.

    The plan is a handful of fixed rows, turned into one ``when`` chain: no range join.  A row that
    no cell covers is an error.
    """
    cell, uncovered = None, F.raise_error(F.concat(F.lit("no cell of the plan for row "), F.col(number).cast("string")))
    for p in plan.orderBy("start").collect():
        value = F.struct(F.lit(p["intent"]).alias("intent"), F.lit(p["language"]).alias("language"),
                         F.lit(p["kind"]).alias("kind"))
        below = F.col(number) < p["end"]
        cell = F.when(below, value) if cell is None else cell.when(below, value)
    empty = "struct<intent: string, language: string, kind: string>"
    cell = uncovered.cast(empty) if cell is None else cell.otherwise(uncovered)
    return rows.withColumn("_cell", cell).select(
        *rows.columns, "_cell.intent", "_cell.language", "_cell.kind")


def indexed(df: DataFrame, order: Column, bucket: Column, number: str = "idx") -> DataFrame:
    """Rows numbered from 0 along ``order`` without a single-task sort, plus their count."""
    return number_rows(df, [], [order], bucket, number).withColumn(number, F.col(number) - 1)


def place_index(places: DataFrame, name: str = "name", seed: int = 0) -> DataFrame:
    """(idx, place, n): distinct places in hash order."""
    distinct = places.select(F.col(name).alias("place")).filter(
        F.coalesce("place", F.lit("")) != "").distinct()
    key = hash_key(seed, F.col("place"))
    return indexed(distinct, key, hash_bucket(key))


def fill_slots(rows: DataFrame, templates: DataFrame, places: DataFrame, key: str,
               seed: int = 42) -> DataFrame:
    """K1: one sentence per row(key, intent, language, kind), with places drawn by hash.

    Three different places are drawn per row by index; the index joins are plain
    equi-joins on evenly spread keys.  A template without {dep} leaves the departure
    empty; only TRIP rows carry slots.  Fewer than three places are an error.
    """
    listed = templates.groupBy("intent", "language", "kind").agg(
        F.sort_array(F.collect_list("template")).alias("choices"))
    indexed_places = place_index(places)
    count = indexed_places.agg(F.count(F.lit(1)).alias("n_places")).select(
        F.when(F.col("n_places") >= 3, F.col("n_places")).otherwise(
            F.raise_error(F.lit("slots need three places at least"))).alias("n_places"))

    def draw(step: str) -> Column:
        return hash_int(seed, F.lit(step), F.col(key))

    n = F.col("n_places")
    low, high = F.least("_dep", "_via"), F.greatest("_dep", "_via")
    third = F.pmod(draw("dest"), n - 2)
    third = third + F.when(third >= low, 1).otherwise(0)
    third = third + F.when(third >= high, 1).otherwise(0)
    drawn = rows.join(listed, ["intent", "language", "kind"]).join(count).withColumns({
        "_template": F.get("choices", F.pmod(draw("template"), F.size("choices")).cast("int")),
        "_dep": F.pmod(draw("dep"), n)}).withColumn(
        "_via", F.pmod(F.col("_dep") + 1 + F.pmod(draw("via"), n - 1), n)).withColumn(
        "_dest", third)
    for slot in ("dep", "via", "dest"):
        drawn = drawn.join(indexed_places.select(F.col("idx").alias(f"_{slot}"),
                                                 F.col("place").alias(slot)), f"_{slot}", "left")
    sentence = F.col("_template")
    for slot in ("dep", "via", "dest"):
        sentence = F.replace(sentence, F.lit("{" + slot + "}"), F.coalesce(slot, F.lit("")))

    def used(slot: str) -> Column:
        wanted = (F.col("intent") == "TRIP") & F.contains("_template", F.lit("{" + slot + "}"))
        return F.when(wanted, F.coalesce(slot, F.lit(""))).otherwise("")

    return drawn.select(
        F.col(key).alias("sentence_id"), sentence.alias("sentence"), "intent", "language",
        used("dep").alias("departure"), used("dest").alias("destination"),
        used("via").alias("intermediate"))


def sequence_id(number: Column, prefix: str = "BASE", width: int = 6) -> Column:
    """BASE000001; wider numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"))


def generate_dataset(spark: SparkSession, total: int, places: DataFrame, seed: int = 42,
                     intermediate_ratio: float = 0.15, templates: DataFrame | None = None
                     ) -> DataFrame:
    """K1 + K2 + F10: ``total`` labelled sentences."""
    rows = spark.range(total).select(F.col("id").alias("row_no"),
                                     sequence_id(F.col("id") + 1).alias("sentence_id"))
    cells = planned_rows(rows, quota_plan(spark, total, intermediate_ratio))
    return fill_slots(cells, templates or template_table(spark), places, "sentence_id", seed)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable shuffle; the range sort behind it is distributed."""
    return df.orderBy(hash_key(seed, F.col(key)), key)


def stratified_split(df: DataFrame, key: str, strata: Sequence[str] = ("intent", "language"),
                     train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Floors for train and val, the remainder to test, within each stratum.

    A stratum may hold most of the rows: it is numbered bucket by bucket.
    """
    order = hash_key(seed, F.col(key))
    numbered = number_rows(df, list(strata), [order, F.col(key)], hash_bucket(order),
                           "_rn", "_n")
    first = F.floor(F.col("_n") * F.lit(train))
    second = first + F.floor(F.col("_n") * F.lit(val))
    return numbered.withColumn("split", F.when(F.col("_rn") <= first, "train").when(
        F.col("_rn") <= second, "val").otherwise("test")).drop("_rn", "_n")


def split_places(places: DataFrame, name: str = "name", train: float = 0.8, val: float = 0.1,
                 seed: int = 42) -> DataFrame:
    """K4: three disjoint pools (place, split)."""
    ranked = place_index(places, name, seed)
    first = F.floor(F.col("n") * F.lit(train))
    second = first + F.floor(F.col("n") * F.lit(val))
    return ranked.select("place", F.when(F.col("idx") < first, "train").when(
        F.col("idx") < second, "val").otherwise("test").alias("split"))


def bio_samples(labelled: DataFrame) -> DataFrame:
    """K6 over a table: (id, tokens, labels, sentence, intent)."""
    tokens = F.col("tokens")
    labels = F.when(F.col("intent") == "TRIP", label_exact(
        tokens, F.col("departure"), F.col("destination"))).otherwise(blank_labels(tokens))
    return labelled.withColumn("tokens", words(F.col("sentence"))).select(
        F.col("sentence_id").alias("id"), "tokens", labels.alias("labels"), "sentence", "intent")


def build_split(split: str, rows: DataFrame, templates: DataFrame, places: DataFrame,
                other: DataFrame, key: str, seed: int = 42, augment: bool = False) -> DataFrame:
    """K5/H5: samples of one split from its own places plus non-travel sentences.

    ``rows(key, intent, language, kind)`` asks for travel sentences; ``other(key,
    sentence)`` are taken as they are.  About 30 % of the training sentences are
    augmented.
    """
    trips = fill_slots(rows, templates, places, key, seed)
    if augment:
        touched = uniform(seed, F.lit("augment"), F.col("sentence_id")) < 0.3
        changed = augment_lightly(trips, "sentence_id", seed).select(
            "sentence_id", F.col("sentence").alias("_noisy"))
        trips = trips.join(changed, "sentence_id").withColumn(
            "sentence", F.when(touched, F.col("_noisy")).otherwise(F.col("sentence"))
        ).drop("_noisy")
    tokens = words(F.col("sentence"))
    plain = other.select(
        F.concat(F.lit(f"GEN_NOT_TRIP_{split}_"), F.col(key).cast("string")).alias("id"),
        tokens.alias("tokens"), blank_labels(tokens).alias("labels"), "sentence",
        F.lit("NOT_TRIP").alias("intent"))
    named = bio_samples(trips).withColumn("id", F.concat(F.lit(f"GEN_TRIP_{split}_"),
                                                         F.col("id").cast("string")))
    return named.unionByName(plain).withColumn("split", F.lit(split))


def leak_check(split_values: DataFrame) -> DataFrame:
    """H6: (split_a, split_b, shared): values that two splits have in common.

    ``split_values(split, value)``.  One aggregate per value finds its set of splits, so
    no split is joined with another, and only digests of the values are shuffled.
    """
    # a value belongs to a handful of splits at most
    digests = split_values.filter(F.col("value").isNotNull()).select(
        "split", F.sha2("value", 256).alias("value"))
    sets = digests.groupBy("value").agg(
        F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    pairs = F.flatten(F.transform("splits", lambda a: F.transform(
        F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy(
        F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")
    ).agg(F.count(F.lit(1)).alias("shared"))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words (the whole text when it is shorter)."""
    def runs(tokens: Column) -> Column:
        n = F.greatest(F.size(tokens) - size + 1, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(
            F.slice(tokens, i, F.lit(size)), " ")))

    return bind(words(F.lower(text)), runs)


def shingle_leaks(train: DataFrame, held_out: DataFrame, key: str, text: str = "text",
                  size: int = 5) -> DataFrame:
    """H6: training rows that share a word run with the held-out set: (key, shared)."""
    seen = held_out.select(F.explode(shingles(F.col(text), size)).alias("shingle")).distinct()
    runs = train.select(key, F.explode(shingles(F.col(text), size)).alias("shingle"))
    return runs.join(seen, "shingle", "left_semi").groupBy(key).agg(
        F.count(F.lit(1)).alias("shared"))


def instruction_pairs(df: DataFrame) -> DataFrame:
    """(sentence_id, input, target) for text-to-text training; 'aucun' for an empty slot."""
    def slot(name: str) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit("aucun"))

    return df.select(
        "sentence_id",
        F.concat(F.lit("Extrais les villes: "), "sentence").alias("input"),
        F.concat(F.lit("DEPART: "), slot("departure"), F.lit(" | ARRIVEE: "), slot("destination"),
                 F.lit(" | VIA: "), slot("intermediate")).alias("target"))


def clean_frame(df: DataFrame) -> DataFrame:
    """Drop rows without sentence or intent, trim, drop blanks, fill slots."""
    slots = ["departure", "destination", "intermediate"]
    return df.na.drop(subset=["sentence", "intent"]).withColumn(
        "sentence", F.trim("sentence")).filter(F.col("sentence") != "").na.fill("", subset=slots)
