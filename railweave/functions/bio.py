"""BIO labels as array expressions (F7, F8, K6-K9).  Token positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railweave.functions.text import bind, words

LABELS = ["O", "B-DEP", "I-DEP", "B-DEST", "I-DEST"]
TAIL_PUNCTUATION = "[.,!?;:'\"]+$"


def positions(items: Column) -> Column:
    """[0 .. n-1]; empty for an empty array."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>"))


def bio_spans(labels: Column, strict_type: bool = False) -> Column:
    """array<struct<type, start, end>> of the labelled runs.

    A run starts at a B- label and goes on through I- labels of any type (F7).  With
    ``strict_type`` an I- label after O or after another type starts a run too, which is
    the usual entity-level scoring rule (E17).
    """
    def at(i: Column) -> Column:
        return F.get(labels, i)

    def kind(i: Column) -> Column:
        return F.substr(at(i), F.lit(3))

    def begins(i: Column) -> Column:
        plain = F.startswith(at(i), F.lit("B-"))
        if not strict_type:
            return plain
        before = F.coalesce(F.get(labels, i - 1), F.lit("O"))
        new_type = (before == "O") | (F.substr(before, F.lit(3)) != kind(i))
        return plain | (F.startswith(at(i), F.lit("I-")) & new_type)

    # every run starts at a break and ends at the next one
    found = F.filter(positions(labels),
                     lambda i: ~F.startswith(at(i), F.lit("I-")) | begins(i))

    def runs(breaks: Column) -> Column:
        ends = F.concat(F.slice(breaks, F.lit(2), F.greatest(F.size(breaks) - 1, F.lit(0))),
                        F.array(F.size(labels)))
        return F.arrays_zip(breaks.alias("start"), ends.alias("end"))

    pairs = F.filter(bind(found, runs), lambda p: p["start"].isNotNull() & begins(p["start"]))
    return F.transform(pairs, lambda p: F.struct(
        kind(p["start"]).alias("type"), p["start"].alias("start"), p["end"].alias("end")))


def decode_slots(tokens: Column, labels: Column) -> Column:
    """struct<departure, destination>; the last span of a type wins."""
    is_dep = lambda s: F.contains(s["type"], F.lit("DEP"))
    is_dest = lambda s: F.contains(s["type"], F.lit("DEST")) & ~is_dep(s)

    def said(span: Column) -> Column:
        return F.when(span.isNotNull(), F.array_join(
            F.slice(tokens, span["start"] + 1, span["end"] - span["start"]), " "))

    def last(spans: Column, condition) -> Column:
        return bind(F.try_element_at(F.filter(spans, condition), F.lit(-1)), said)

    # the fitted labels and the spans are worked out once per row, not once per label that looks at them
    paired = F.slice(labels, F.lit(1), F.least(F.size(labels), F.size(tokens)))
    return bind(F.struct(paired.alias("labels")), lambda b: bind(bio_spans(b["labels"]), lambda spans: F.struct(
        last(spans, is_dep).alias("departure"), last(spans, is_dest).alias("destination"))))


def _starts(tokens: Column, target: Column) -> Column:
    """Positions where the token window equals the target words."""
    last = F.size(tokens) - F.size(target)
    return F.when((F.size(target) > 0) & (last >= 0), F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.slice(tokens, i + 1, F.size(target)) == target)
    ).otherwise(F.array().cast("array<int>"))


def _write(labels: Column, start: Column, length: Column, name: str,
           only_free: bool = False) -> Column:
    """Put B-/I- labels on a span; NULL start leaves the labels alone."""
    def label(old: Column, i: Column) -> Column:
        inside = (i >= start) & (i < start + length)
        if only_free:
            inside = inside & (old == "O")
        return F.when(inside & (i == start), f"B-{name}").when(inside, f"I-{name}").otherwise(old)

    return F.when(start.isNull(), labels).otherwise(F.transform(labels, label))


def blank_labels(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lit("O"))


def label_exact(tokens: Column, departure: Column, destination: Column) -> Column:
    """K6: first exact windows, case and trailing punctuation aside; no overlap."""
    parts = F.struct(
        F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), TAIL_PUNCTUATION, ""))
        .alias("plain"),
        words(F.lower(F.coalesce(departure, F.lit("")))).alias("dep"),
        words(F.lower(F.coalesce(destination, F.lit("")))).alias("dest"))

    def placed(p: Column) -> Column:
        return F.struct(F.array_min(_starts(p["plain"], p["dep"])).alias("dep"),
                        F.size(p["dep"]).alias("n_dep"), F.size(p["dest"]).alias("n_dest"),
                        _starts(p["plain"], p["dest"]).alias("dests"))

    def written(p: Column) -> Column:
        free = F.filter(p["dests"], lambda i: p["dep"].isNull() | ~(
            (i < p["dep"] + p["n_dep"]) & (i + p["n_dest"] > p["dep"])))
        labels = _write(blank_labels(tokens), p["dep"], p["n_dep"], "DEP")
        return bind(F.array_min(free), lambda f: _write(labels, f, p["n_dest"], "DEST"))

    return bind(bind(parts, placed), written)


def normalise_token(token: Column) -> Column:
    """K7: lower case, apostrophes and hyphens as blanks, blanks squeezed."""
    spaced = F.translate(F.trim(F.lower(token)), "'-", "  ")
    return F.regexp_replace(spaced, r"(?U)\s+", " ")


def label_normalised(tokens: Column, departure: Column, destination: Column,
                     intent: Column) -> Column:
    """K7: labels after token normalisation; NULL for a TRIP none of whose slots align."""
    parts = F.struct(
        F.transform(tokens, normalise_token).alias("plain"),
        words(normalise_token(F.coalesce(departure, F.lit("")))).alias("dep"),
        words(normalise_token(F.coalesce(destination, F.lit("")))).alias("dest"))

    def placed(p: Column) -> Column:
        return F.struct(
            F.array_min(_starts(p["plain"], p["dep"])).alias("dep"),
            F.array_min(_starts(p["plain"], p["dest"])).alias("dest"),
            F.size(p["dep"]).alias("n_dep"), F.size(p["dest"]).alias("n_dest"))

    def written(p: Column) -> Column:
        blank = blank_labels(tokens)
        with_dep = _write(blank, p["dep"], p["n_dep"], "DEP")
        # a destination that starts inside the departure is not written
        inside = p["dep"].isNotNull() & (p["dest"] >= p["dep"]) & (
            p["dest"] < p["dep"] + p["n_dep"])
        labels = F.when(inside, with_dep).otherwise(
            _write(with_dep, p["dest"], p["n_dest"], "DEST", only_free=True))
        lost = (intent == "TRIP") & p["dep"].isNull() & p["dest"].isNull() & (
            p["n_dep"] + p["n_dest"] > 0)
        return F.when(F.size(tokens) == 0, F.lit(None).cast("array<string>")).when(
            intent == "NOT_TRIP", blank).when(~lost, labels)

    return bind(bind(parts, placed), written)


def location_roles(labels: Column, n_tokens: Column) -> Column:
    """K8/F8: B/I-LOC to roles (first place departs, later ones arrive), fitted to the tokens."""
    tags = F.transform(labels, F.upper)
    places = F.filter(positions(tags), lambda i: F.get(tags, i) == "B-LOC")
    first, second = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    roles = F.transform(tags, lambda t, i: F.when(
        t == "B-LOC", F.when(i == first, "B-DEP").otherwise("B-DEST")).when(
        t == "I-LOC", F.when(second.isNull() | (i < second), "I-DEP").otherwise("I-DEST")
    ).otherwise("O"))
    return F.slice(F.concat(roles, F.array_repeat(F.lit("O"), n_tokens)), F.lit(1), n_tokens)


def label_by_characters(text: Column, spans: Column, entities: dict[str, Column]) -> Column:
    """K9: tokens that overlap an entity's characters; the longest prefix of at least three
    characters stands in for an entity that is not found whole.  Later entities overwrite.
    """
    labels = F.transform(spans, lambda s: F.lit("O"))
    for name, entity in entities.items():
        labels = _mark_entity(labels, text, spans, entity, name)
    return labels


def _mark_entity(labels: Column, text: Column, spans: Column, entity: Column, name: str) -> Column:
    both = F.struct(F.lower(text).alias("text"),
                    F.lower(F.coalesce(entity, F.lit(""))).alias("value"))

    def extent(b: Column) -> Column:
        # the whole entity counts at any length, its prefixes down to three characters
        n = F.length(b["value"])
        length = F.when(n > 0, F.get(F.filter(
            F.sequence(n, F.least(n, F.lit(3)), F.lit(-1)),
            lambda k: F.contains(b["text"], F.substring(b["value"], F.lit(1), k))), F.lit(0)))
        return bind(length, lambda k: F.struct(k.alias("length"), (F.call_function(
            "locate", F.substring(b["value"], F.lit(1), k), b["text"]) - 1).alias("start")))

    def hits(e: Column) -> Column:
        inside = F.filter(positions(spans), lambda i: (
            F.get(spans, i)["start"] < e["start"] + e["length"])
            & (F.get(spans, i)["end"] > e["start"]))
        return F.when(e["length"].isNotNull(), inside)

    return bind(bind(bind(both, extent), hits), lambda h: _write(labels, F.array_min(h), F.size(h), name))
