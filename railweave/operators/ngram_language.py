"""Character n-gram language profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions.labels import labelled, language_of_code
from railweave.functions.text import squeeze_blanks
from railweave.operators.scale import Stage

SIZE = 3
#: Most numbers (grams times languages) of a profile that each worker keeps in memory: 64 MB and the keys.
MAX_CELLS = 8_000_000


def padded_text(text: Column) -> Column:
    """The lowered text, blanks squeezed, one blank at each end."""
    return F.concat(F.lit(" "), squeeze_blanks(F.lower(text)), F.lit(" "))


def ngrams(text: Column, size: int = SIZE) -> Column:
    """Character n-grams of the padded text."""
    # a capturing lookahead reads overlapping runs in one pass over the text
    return F.regexp_extract_all(padded_text(text), F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def gram_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, gram, n).  The count is combined map-side before it is shuffled."""
    return docs.select(key, F.explode(ngrams(F.col(text))).alias("gram")).groupBy(
        key, "gram").agg(F.count(F.lit(1)).alias("n"))


def train_profiles(docs: DataFrame, label: str = "lang", text: str = "text") -> DataFrame:
    """(gram, logp): add-one smoothed n-gram log-probabilities, one struct field per language.

    One row per gram keeps the scoring join from multiplying rows by languages.  The
    languages are the few values of the label column.
    """
    langs = sorted(r[0] for r in docs.select(label).distinct().collect() if r[0] is not None)
    counts = gram_counts(docs, label, text).groupBy("gram").agg(*[
        F.coalesce(F.sum(F.when(F.col(label) == lang, F.col("n"))), F.lit(0)).alias(f"n_{i}")
        for i, lang in enumerate(langs)])
    totals = counts.agg(F.count(F.lit(1)).alias("vocabulary"),
                        *[F.sum(f"n_{i}").alias(f"total_{i}") for i in range(len(langs))])
    # a single row of totals stands beside every gram
    return counts.join(totals).select("gram", F.struct(*[
        F.log((F.col(f"n_{i}") + 1) / (F.col(f"total_{i}") + F.col("vocabulary"))).alias(lang)
        for i, lang in enumerate(langs)]).alias("logp"))


def gram_codes(text: str) -> np.ndarray:
    """Each run of three code points as one number of 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def score_in_place(docs: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, sums): log-likelihood of each text per language, null without a known gram.

    Each worker holds the profile as sorted gram codes beside a matrix, so rows stay where they are.
    """
    langs = profiles.schema["logp"].dataType.fieldNames()
    table = profiles.select("gram", *[F.col("logp")[lang].alias(f"p_{i}") for i, lang in enumerate(langs)]).toArrow()
    codes = gram_codes("".join(table["gram"].to_pylist()))[::SIZE]
    order = np.argsort(codes)
    matrix = np.column_stack([table[f"p_{i}"].to_numpy() for i in range(len(langs))])[order]
    shared = docs.sparkSession.sparkContext.broadcast((codes[order], matrix))

    @F.pandas_udf("array<double>")
    def sums(texts: pd.Series) -> pd.Series:
        known, logp = shared.value

        def of(value: str | None) -> np.ndarray | None:
            if value is None or len(value) < SIZE:
                return None
            grams = gram_codes(value)
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            at = at[known[at] == grams]
            return logp[at].sum(axis=0) if len(at) else None

        return pd.Series([of(value) for value in texts], dtype=object)

    return docs.select(key, text, sums(padded_text(F.col(text))).alias("sums"))


def score_by_join(docs: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """As ``score_in_place`` for a profile of any size: grams of the texts meet it by a join."""
    langs = profiles.schema["logp"].dataType.fieldNames()
    sums = gram_counts(docs, key, text).join(profiles, "gram").groupBy(key).agg(F.array(*[
        F.sum(F.col("n") * F.col("logp")[lang]) for lang in langs]).alias("sums"))
    return docs.select(key, text).join(sums, key, "left")


def score_languages(docs: DataFrame, profiles: DataFrame, key: str, text: str = "text",
                    max_cells: int = MAX_CELLS) -> DataFrame:
    """(key, text, scores): log-likelihood per language as array<struct<score, lang>>, one row per text."""
    langs = profiles.schema["logp"].dataType.fieldNames()
    profiles = Stage(docs.sparkSession, "profiles").save(profiles)
    grams = profiles.count()
    score = score_in_place if 0 < grams * len(langs) <= max_cells else score_by_join
    names = F.array(*[F.lit(lang) for lang in langs])
    return score(docs, profiles, key, text).select(key, text, F.zip_with(
        "sums", names, lambda s, lang: F.struct(s.alias("score"), lang.alias("lang"))).alias("scores"))


def detect_languages(docs: DataFrame, profiles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, label, conf, score): top language mapped to three classes; short texts UNKNOWN."""
    best = score_languages(docs, profiles, key, text).select(
        key, text, "scores", F.array_max("scores").alias("top"))
    share = F.lit(1.0) / F.aggregate(
        "scores", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - F.col("top.score")))
    label = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 3, labelled("UNKNOWN", 0.5)).when(
        F.col("top").isNull(), labelled("UNKNOWN", 0.4)).otherwise(
        labelled(language_of_code(F.col("top.lang")), share))
    return best.select(
        key, label.alias("r"), F.col("top.score").alias("score")).select(
        key, "r.label", "r.conf", F.col("score"))
