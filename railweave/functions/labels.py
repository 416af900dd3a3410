"""Label, flag and prediction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railweave.functions import wordlists as W
from railweave.functions.text import strip_blanks, words

INTENTS = ["TRIP", "NOT_TRIP", "UNKNOWN"]
LANGUAGES = ["FRENCH", "ENGLISH", "UNKNOWN"]


def labelled(label: Column | str, confidence: Column | float) -> Column:
    """struct<label, conf>, the result type of every labeller."""
    label = F.lit(label) if isinstance(label, str) else label
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(label.alias("label"), confidence.cast("double").alias("conf"))


def whole_words(phrases: list[str], flags: str = "iUd") -> str:
    """One alternation over phrases, each between word boundaries.

    All phrases begin with an ASCII letter; saying so up front skips most positions.
    """
    return f"(?{flags})\\b(?=[a-z])(?:{'|'.join(phrases)})\\b"


def map_intent_label(label: Column) -> Column:
    """B13."""
    tidy = strip_blanks(F.upper(label))
    return F.when(tidy == "VALID", "TRIP").when(tidy == "INVALID", "NOT_TRIP").otherwise(tidy)


def map_language_label(label: Column) -> Column:
    """B14."""
    tidy = strip_blanks(F.upper(label))
    return F.when(tidy.isin("FRENCH", "ENGLISH"), tidy).otherwise("UNKNOWN")


def language_of_code(code: Column) -> Column:
    """Language class of a two-letter code (J2 mapping)."""
    return F.when(code == "fr", "FRENCH").when(code == "en", "ENGLISH").otherwise("UNKNOWN")


def normalize_location(slot: Column) -> Column:
    """B15: '' is absent; a blank-only value survives as '' because the test precedes the trim."""
    return strip_blanks(F.nullif(slot, F.lit("")))


def city_of_station(station: Column) -> Column:
    """Text before the first hyphen."""
    return F.substring_index(normalize_location(station), "-", 1)


def is_misspelled(sentence: Column, departure: Column, destination: Column) -> Column:
    """A true slot that the sentence does not hold."""

    def absent(slot: Column) -> Column:
        slot = F.coalesce(slot, F.lit(""))
        return (slot != "") & ~F.contains(F.lower(sentence), F.lower(slot))

    return absent(departure) | absent(destination)


def starts_lowercase(sentence: Column) -> Column:
    """The first letter is lower case."""
    return F.coalesce(sentence.rlike(r"(?s)^\P{L}*\p{Ll}"), F.lit(False))


def label_language(text: Column) -> Column:
    """Keyword counts decide between three languages."""
    french = F.regexp_count(text, F.lit(whole_words(W.FRENCH_PHRASES)))
    english = F.regexp_count(text, F.lit(whole_words(W.ENGLISH_PHRASES)))
    other = F.regexp_count(text, F.lit(whole_words(W.OTHER_PHRASES)))
    counts = F.struct(french.alias("f"), english.alias("e"), other.alias("o"))

    def decide(c: Column) -> Column:
        f, e, o = c["f"], c["e"], c["o"]

        def share(n: Column) -> Column:
            return F.least(F.lit(0.95), F.lit(0.5) + (n / (f + e + o + 1)) * F.lit(0.5))

        return (
            F.when(F.length(strip_blanks(text)) < 2, labelled("UNKNOWN", 0.5))
            .when((o > 0) & (o >= F.greatest(f, e)), labelled("UNKNOWN", 0.7))
            .when(f + e + o == 0, labelled("UNKNOWN", 0.4))
            .when(f > e, labelled("FRENCH", share(f)))
            .when(e > f, labelled("ENGLISH", share(e)))
            .when((f > 0) & text.rlike(whole_words(W.FRENCH_TIE_WORDS)), labelled("FRENCH", 0.6))
            .when(f > 0, labelled("UNKNOWN", 0.5))
            .otherwise(labelled("UNKNOWN", 0.4))
        )

    # A one-element transform binds the counts, so each pattern runs once per row.
    decided = F.element_at(F.transform(F.array(counts), decide), 1)
    return F.coalesce(decided, labelled("UNKNOWN", 0.5))


def label_intent(text: Column) -> Column:
    """Indicator words, then sentence length."""
    lowered = strip_blanks(F.lower(text))
    n_words = F.size(words(lowered))
    return (
        F.when(text.isNull() | (F.length(lowered) < 3), labelled("UNKNOWN", 0.8))
        .when(lowered.rlike(whole_words(W.TRIP_PHRASES)), labelled("TRIP", 0.8))
        .when(n_words.between(2, 4), labelled("TRIP", 0.5))
        .otherwise(labelled("NOT_TRIP", 0.6))
    )


def label_intent_by_mentions(n_mentions: Column) -> Column:
    """More places, more confidence."""
    return F.when(
        n_mentions > 0, labelled("TRIP", F.least(F.lit(0.5) + n_mentions * F.lit(0.1), F.lit(0.8)))
    ).otherwise(labelled("NOT_TRIP", 0.5))


def gate_short(text: Column, label: Column, min_length: int = 3) -> Column:
    """Too short a text gets the default label; others keep theirs, in place."""
    return F.when(F.length(strip_blanks(text)) < min_length, labelled("UNKNOWN", 0.5)).otherwise(label)


def parse_output_label(output: Column) -> Column:
    """First key found in a generated label; longer keys are tried first."""
    tidy = F.replace(F.lower(strip_blanks(output)), F.lit("_"), F.lit(" "))
    keys = {k.replace("_", " "): v for k, v in W.OUTPUT_LABELS.items()}
    result = None
    for key in sorted(keys, key=len, reverse=True):
        value = labelled(keys[key], 0.9)
        found = F.contains(tidy, F.lit(key))
        result = F.when(found, value) if result is None else result.when(found, value)
    return result.otherwise(labelled("UNKNOWN", 0.5))


def parse_input_line(line: Column) -> Column:
    """B22: 'ID, text' or a bare text."""
    parts = F.split(line, ",", 2)
    return F.when(
        F.contains(line, F.lit(",")),
        F.struct(strip_blanks(parts[0]).alias("id"), strip_blanks(parts[1]).alias("text")),
    ).otherwise(F.struct(F.lit("AUTO").alias("id"), strip_blanks(line).alias("text")))


def is_valid_trip(intent: Column, departure: Column, destination: Column) -> Column:
    """B26."""
    filled = [F.coalesce(slot, F.lit("")) != "" for slot in (departure, destination)]
    return (intent == "TRIP") & filled[0] & filled[1]


def downgrade_intent(intent: Column, departure: Column, destination: Column) -> Column:
    """TRIP without any slot becomes NOT_TRIP; ``intent`` is struct<label, conf>."""
    empty = (F.coalesce(departure, F.lit("")) == "") & (F.coalesce(destination, F.lit("")) == "")
    return F.when((intent["label"] == "TRIP") & empty, labelled("NOT_TRIP", 0.5)).otherwise(intent)


def entity_match(raw: Column, matched: Column) -> Column:
    """NULL without a mention, else what was read and what it was linked to."""
    hit = matched.isNotNull() & (matched != "")
    return F.when(
        F.coalesce(raw, F.lit("")) != "",
        F.struct(raw.alias("raw"), matched.alias("matched"),
                 F.when(hit, 1.0).otherwise(0.0).alias("confidence")),
    )


def rename_id(sentence_id: Column) -> Column:
    """B29."""
    return F.regexp_replace(sentence_id, "^BASE", "STT")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 when there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def french_word_ratio(text: Column) -> Column:
    """Share of a text's distinct words that are French function words."""
    distinct = F.array_distinct(words(F.lower(text)))
    known = F.array_intersect(distinct, F.array(*map(F.lit, W.FRENCH_SENTENCE_WORDS)))
    return F.size(known) / F.greatest(F.size(distinct), F.lit(1))


def looks_french(text: Column) -> Column:
    """Ratio at least .15, or too few words to tell."""
    few = F.size(F.array_distinct(words(F.lower(text)))) <= 2
    return (french_word_ratio(text) >= 0.15) | few


def has_word_of(text: Column, vocabulary: list[str]) -> Column:
    """H2: any word of the text is in the vocabulary."""
    return F.arrays_overlap(words(F.lower(text)), F.array(*map(F.lit, vocabulary)))


def sentence_code(text: Column, departure: Column, destination: Column) -> Column:
    """NULL for a complete request, else why it is not one."""
    has_dep = F.coalesce(departure, F.lit("")) != ""
    has_dest = F.coalesce(destination, F.lit("")) != ""
    return (
        F.when(has_dep & has_dest, F.lit(None).cast("string"))
        .when(~looks_french(text), "NOT_FRENCH")
        .when(~has_word_of(text, W.TRIP_SENTENCE_WORDS) & ~has_dep & ~has_dest, "NOT_TRIP")
        .otherwise("UNKNOWN")
    )


def extraction_line(sentence_id: Column, departure: Column, destination: Column,
                    code: Column) -> Column:
    """A15: 'id,dep,dest', 'id,dep|?,dest|?,code' or 'id,code'.

    A sentence coded NOT_FRENCH or NOT_TRIP reports no slot.
    """
    keep = code.isNull() | (code == "UNKNOWN")
    dep = F.when(keep, F.nullif(departure, F.lit("")))
    dest = F.when(keep, F.nullif(destination, F.lit("")))
    return (
        F.when(code.isNull(), F.concat_ws(",", sentence_id, dep, dest))
        .when(dep.isNotNull() | dest.isNotNull(),
              F.concat_ws(",", sentence_id, F.coalesce(dep, F.lit("?")),
                          F.coalesce(dest, F.lit("?")), code))
        .otherwise(F.concat_ws(",", sentence_id, code))
    )


def route_line(sentence_id: Column, path: Column, error: Column) -> Column:
    """A14: 'id, s1, s2, ...' or 'id, INVALID'."""
    bad = error.isNotNull() | path.isNull() | (F.size(path) == 0)
    return F.when(bad, F.concat(sentence_id, F.lit(", INVALID"))).otherwise(
        F.concat_ws(", ", sentence_id, F.array_join(path, ", ")))
