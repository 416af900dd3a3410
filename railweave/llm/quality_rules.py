"""Quality rules of documents and hosts (operator 6); DataFrame functions only.

Each text is measured inside its own row: lines and three-word windows are compared as arrays, so no word
is shuffled.  Failures of the base rules are counted per host (here the column source), the rates are
shrunk towards the whole by a beta prior fitted to the rates of all hosts, and a host whose shrunk rate
exceeds ``HOST_BAR`` takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.llm.frames import WORD, stored

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_BAR = 0.75
#: Strength of the prior if all hosts have one rate, as then no spread can be measured.
PLAIN_STRENGTH = 100.0
#: Hosts up to which their verdicts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def _repeat_words(grams: Column) -> Column:
    """Words in windows found twice or more; ``grams`` holds the hash of the window at each word."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    n = F.size(grams)
    # Of sorted windows, each is compared with the next; both of an equal pair count.
    twins = F.flatten(F.filter(
        F.zip_with(F.slice(pairs, 1, n - 1), F.slice(pairs, 2, n - 1),
                   lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull()))
    words = F.flatten(F.transform(F.array_distinct(twins), lambda i: F.array(i, i + 1, i + 2)))
    return F.when(F.size(F.array_distinct(grams)) == n, 0).otherwise(F.size(F.array_distinct(words)))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, beside ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    hashed = words.select(
        *keep, F.size("_words").alias("n_words"), F.length(F.array_join("_words", "")).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).alias("n_symbols"), lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    here = F.col("_hashes")
    grams = F.when(F.size(here) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(here, 1, F.greatest(F.size(here) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(here, i + 1), F.get(here, i + 2))))
    return hashed.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), grams.alias("_grams")
    ).select(*keep, *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
             _repeat_words(F.col("_grams")).cast("bigint").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, host: str, bar: float = HOST_BAR) -> DataFrame:
    """(host, n, failures, rate, host_kept): failure rates shrunk by an empirical beta prior.

    The prior has the mean and the variance of the hosts' own rates; without spread it gets
    ``PLAIN_STRENGTH`` documents.
    """
    hosts = measured.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"))
    strength = F.when(F.col("spread") > 0, F.greatest(
        F.col("mean") * (1 - F.col("mean")) / F.greatest("spread", F.lit(1e-12)) - 1, F.lit(0.0))
    ).otherwise(PLAIN_STRENGTH)
    prior = prior.select("mean", strength.alias("strength"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior), F.lit(True)).select(
        host, "n", "failures", shrunk.alias("rate"), (shrunk <= bar).alias("host_kept"))


def quality_rules(docs: DataFrame, host: str = "source", bar: float = HOST_BAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, the five measures, base_failed, kept.

    base_failed: fewer than 50 words, or more than 50 % of the words in three-word windows that occur
    twice; kept: not base_failed, and the host's shrunk failure rate is at most ``bar``.  Null texts count
    as empty and fail; null hosts are one host of their own.  Other columns are ignored, repeated rows count
    each; no rows give no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = docs.select("doc_id", "text", F.col(host).alias("_host"))
    measured = stored(measure(rows, ["doc_id", "_host"]).withColumn("base_failed", failed), "measured")
    hosts = stored(host_verdicts(measured, "_host", bar), "hosts")
    verdicts = hosts.select(F.col("_host").alias("_judged"), "host_kept")
    if hosts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    return measured.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged")), "left").select(
        "doc_id", F.col("_host").alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
