"""Toxicity by multiple-instance learning (operator 8).

A sentence scores by a logistic model on its hashed words and their prefixes; a document is toxic unless all its sentences
are clean (noisy-or).  Only document labels are known: the gradient of the noisy-or hands each sentence its
share, so the model finds the sentences that are to blame.  Words and sentences are cut on the bytes of
whole texts, in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm import bytewords as bw
from railweave.llm.frames import append_columns
from railweave.llm.labelled import crc_rest, labelled_sample

BUCKETS = 1 << 18
#: Prefixes of a word, in bytes, that are features beside the word.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Labelled documents per label value that are used for the fit at most.
TRAIN_PER_LABEL = 2000
STEPS, RATE, PENALTY = 150, 0.1, 3e-4
#: Share of the sampled documents that must hold a feature.
LEAST_SHARE = 0.004
BAR = 0.3
SENTENCE_BAR = 0.3

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


class Cut(NamedTuple):
    """Texts cut into sentences: features of each distinct word, and which word stands in which sentence.

    Only sentences with a word count.  ``features`` has one row per distinct word, filled up with ``BUCKETS``.
    """

    hash: np.ndarray
    features: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[Cut, bw.Words]:
    """The sentences of a slice of texts, and its words."""
    w = bw.words(data, offsets, lower=True, letters=True)
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))[w.start]
    new = np.ones(len(w.start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (w.doc[1:] != w.doc[:-1])
    sentence = (np.cumsum(new) - 1).astype(np.int32)
    known, at, word = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[at], w.end[at]
    features = np.full((len(known), 1 + len(PREFIXES)), BUCKETS, np.int32)
    features[:, 0] = known % np.uint64(BUCKETS)
    for column, k in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(end - start > k)
        prefix = bw.span_hash(data, start[longer], start[longer] + k, True) + np.uint64(k)
        features[longer, column] = prefix % np.uint64(BUCKETS)
    return Cut(known, features, word.astype(np.int32), sentence, w.doc[new].astype(np.int32)), w


def _logits(cut: Cut, model: np.ndarray) -> np.ndarray:
    """Score of each sentence before the logistic function."""
    by_word = np.where(cut.features < BUCKETS, model[cut.features], 0).sum(axis=1)
    return np.clip(np.bincount(cut.sentence, weights=by_word[cut.word], minlength=len(cut.doc)) + model[-1], -60, 60)


def joined(cuts: list[Cut], n_docs: list[int]) -> Cut:
    """One cut of all texts; sentences and documents count on, and a word has one row of features."""
    if not cuts:
        empty = np.zeros(0, np.int32)
        return Cut(np.zeros(0, np.uint64), np.zeros((0, 1 + len(PREFIXES)), np.int32), empty, empty, empty)
    known, at, place = np.unique(np.concatenate([c.hash for c in cuts]), return_index=True, return_inverse=True)
    words = np.cumsum([0] + [len(c.hash) for c in cuts])
    before = np.cumsum([0] + [len(c.doc) for c in cuts])
    docs = np.cumsum([0] + n_docs)
    return Cut(
        known, np.concatenate([c.features for c in cuts])[at],
        np.concatenate([place[words[i]:words[i + 1]].astype(np.int32)[c.word] for i, c in enumerate(cuts)]),
        np.concatenate([c.sentence + np.int32(before[i]) for i, c in enumerate(cuts)]),
        np.concatenate([c.doc + np.int32(docs[i]) for i, c in enumerate(cuts)]))


def holders(cut: Cut, n_docs: int, block: int = 100) -> np.ndarray:
    """Number of documents that hold each feature, counted over blocks of documents."""
    pairs = np.unique(cut.doc[cut.sentence].astype(np.int64) * max(1, len(cut.hash)) + cut.word)
    doc, word = np.divmod(pairs, max(1, len(cut.hash)))
    held = np.zeros(BUCKETS + 1, np.int64)
    for low in range(0, n_docs, block):
        a, b = np.searchsorted(doc, (low, low + block))
        keys = np.unique(doc[a:b, None] * (BUCKETS + 1) + cut.features[word[a:b]])
        held += np.bincount(keys % (BUCKETS + 1), minlength=BUCKETS + 1)
    return held[:-1]


def fit(cut: Cut, y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Feature weights and, last, the bias; ``ratio`` is the weight of a document of label 0 and 1.

    Adam on the log loss of the noisy-or with an L1 penalty that keeps words of little evidence at 0.  Scores
    and slopes go by distinct words, so that no array has a row for each feature of each word.  Without
    documents every score is all but 0.
    """
    model = np.zeros(BUCKETS + 1)
    n = len(y)
    if not n:
        model[-1] = -60.0
        return model
    common = np.append(holders(cut, n) >= max(3, LEAST_SHARE * n), False)
    cut = cut._replace(features=np.where(common[cut.features], cut.features, BUCKETS))
    weight = ratio[y]
    total = weight.sum()
    model[-1] = np.log(max((weight * y).sum() / total, 1e-4) / max(1.0, len(cut.doc) / n))
    first, second = np.zeros_like(model), np.zeros_like(model)
    for t in range(1, STEPS + 1):
        z = _logits(cut, model)
        whole = np.maximum(-np.expm1(-np.bincount(cut.doc, weights=np.logaddexp(0, z), minlength=n)), 1e-9)
        share = (weight / total * (whole - y) / whole)[cut.doc] / (1 + np.exp(-z))
        by_word = np.bincount(cut.word, weights=share[cut.sentence], minlength=len(cut.hash))
        slope = np.zeros_like(model)
        for column in cut.features.T:
            slope += np.bincount(column, weights=by_word, minlength=BUCKETS + 1)
        slope[-1] = share.sum()
        words, now = slope[:-1], model[:-1]
        slope[:-1] = np.where(now != 0, words + PENALTY * np.sign(now),
                              np.sign(words) * np.maximum(np.abs(words) - PENALTY, 0))
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        moved = model - RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-7)
        moved[:-1][np.sign(moved[:-1]) * np.sign(now) < 0] = 0
        model = moved
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> np.ndarray:
    """The model from a bounded sample of labelled documents that are not held out.

    Sampled documents weigh as much as their label does among all labels that may be read.
    """
    allowed = crc_rest(F.col("doc_id"), 4) != 2
    known = labels.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    sample = labelled_sample(docs, known, "toxic", allowed, per_label, ["text"])
    counts = {r["toxic"]: r["count"] for r in known.filter(allowed & F.col("toxic").isNotNull()).groupBy(
        "toxic").count().collect()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in bw.slices(batch.column(0)):
                cut, _ = sentences(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()]) for x in (*cut, y[low:high].astype(np.int8))],
                    names=[*Cut._fields, "y"])

    rows = sample.select("text", "y").mapInArrow(
        encode, ", ".join(f"{c} binary" for c in (*Cut._fields, "y"))).collect()
    y = np.frombuffer(b"".join(r["y"] for r in rows), np.int8)
    cuts = [Cut(np.frombuffer(r["hash"], np.uint64),
                np.frombuffer(r["features"], np.int32).reshape(-1, 1 + len(PREFIXES)),
                *[np.frombuffer(r[c], np.int32) for c in ("word", "sentence", "doc")]) for r in rows]
    seen = np.bincount(y, minlength=2)
    return fit(joined(cuts, [len(r["y"]) for r in rows]), y,
               np.array([counts.get(v, 0) / max(1, seen[v]) for v in (0, 1)]))


def score_documents(docs: DataFrame, model: np.ndarray, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``, 0 to 1; null, empty and wordless texts have 0."""
    small = model.astype(np.float32)
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros(batch.num_rows)
        for low, high, data, offsets in bw.slices(batch.column(at)):
            cut, _ = sentences(data, offsets)
            z = _logits(cut, small)
            out[low:high] = -np.expm1(-np.bincount(cut.doc, weights=np.logaddexp(0, z), minlength=high - low))
        return [pa.array(np.clip(out, 0.0, 1.0))]

    return append_columns(docs, make, [(score, "double")])


def offending_sentences(docs: DataFrame, model: np.ndarray, bar: float = SENTENCE_BAR) -> DataFrame:
    """(doc_id, sentence, score, text) of each sentence whose own score reaches ``bar``.

    ``sentence`` counts the sentences with a word from 0; the text runs from its first to its last word.
    """
    small = model.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in bw.slices(batch.column(1)):
                cut, w = sentences(data, offsets)
                of_word, doc = cut.sentence, cut.doc
                p = 1 / (1 + np.exp(-_logits(cut, small)))
                bad = np.flatnonzero(p >= bar)
                first = np.searchsorted(of_word, bad)
                last = np.searchsorted(of_word, bad, "right") - 1
                number = bad - np.searchsorted(doc, doc[bad])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(low + doc[bad])), pa.array(number), pa.array(p[bad]),
                     pa.array([data[w.start[a]:w.end[b]].tobytes().decode(errors="replace")
                               for a, b in zip(first, last)], pa.string())],
                    names=["doc_id", "sentence", "score", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence long, score double, text string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels (doc_id, toxic) of documents whose crc32 mod 4 is 2 are never read.  Null and empty texts score
    0; a row without doc_id is scored and not held out; null labels are left out, repeated ones take the
    larger.  Other columns are ignored; no rows give no rows.
    """
    model = train(docs, labels)
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(crc_rest(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= BAR).cast("int").alias("predicted"))
