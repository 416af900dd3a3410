"""Benchmark decontamination by latent semantic retrieval (operator 5).

Passages of ``STEP`` words are TF-IDF vectors over ``TERMS`` hashed terms; IDF is the log of all words over
the occurrences of a term.  A distributed randomised SVD finds their main directions: every task multiplies
its part A of the matrix with a sparse random matrix S (one signed entry per term) and back, the small
products A'AS are summed, and their Nystroem form gives singular vectors and values.  Latent vectors are
those of the left side (divided by the singular values).  Windows of ``PASSAGE`` words of all documents,
overlapping by half, meet the passages of the benchmark by cosine in that space.  Candidates that share too
little weight of terms with the item fall out; for the others the longest common subsequence of words between the item and the surroundings of the
window decides: ``LEAK_SHARE`` of the item is a leak, and from ``PARAPHRASE_SHARE`` on it is one if the
answer (the item's last sentence, or its last fifth if it is one sentence) is there as well.

The benchmark is the stated query set; it meets all documents in blocks of ``BLOCK_ITEMS`` items, so a
task holds one bounded block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railweave.llm import bytewords as bw

TERMS = 4096
RANK = 48
PASSAGE = 24
STEP = 12
ITEM_STEP = 6
#: Least cosine, and that for items of fewer words than a window, which other words dilute.
COSINE, SHORT_COSINE = 0.5, 0.4
#: Least share of the term weight of the window, or of the item if that is less, that both hold.
SHARED = 0.4
LEAK_SHARE = 0.8
PARAPHRASE_SHARE = 0.55
ANSWER_SHARE = 0.8
BLOCK_ITEMS = 2000


def _terms(w: bw.Words) -> np.ndarray:
    return (w.hash % np.uint64(TERMS)).astype(np.int64)


def _cut(w: bw.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, number in the document) of consecutive pieces of ``width`` words."""
    counts, firsts = w.counts(), w.firsts()
    n = -(-counts // width)
    doc = np.repeat(np.arange(w.n_docs), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return firsts[doc] + number * width, doc, number


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of each hashed term over all words of ``docs`` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, _, data, offsets in bw.slices(batch.column(0)):
                counts += np.bincount(_terms(bw.words(data, offsets, lower=True)), minlength=TERMS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS)), pa.array(counts)], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(TERMS)
    for r in found.collect():
        counts[r["term"]] = r["n"]
    return np.log((counts.sum() + 2) / (counts + 1)) / np.log(TERMS)


def directions(docs: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(term, direction): right singular vectors over singular values of all passages, times IDF."""
    rng = np.random.RandomState(3)
    column, sign = rng.randint(0, rank, TERMS), rng.choice([-1.0, 1.0], TERMS)
    weight = sign * idf
    names = [f"y{i}" for i in range(rank)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS * rank)
        for batch in batches:
            for _, _, data, offsets in bw.slices(batch.column(0)):
                w = bw.words(data, offsets, lower=True)
                term = _terms(w)
                first, _, _ = _cut(w, STEP)
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
                row, to, value = term * rank, column[term], weight[term]
                total += np.bincount(row + to, value, TERMS * rank)
                for d in range(1, STEP):
                    at = np.flatnonzero(owner[d:] == owner[:-d])
                    total += np.bincount(row[at] + to[at + d], value[at + d], TERMS * rank)
                    total += np.bincount(row[at + d] + to[at], value[at], TERMS * rank)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(TERMS)), *[pa.array(c) for c in total.reshape(TERMS, rank).T.copy()]],
            names=["term", *names])

    sums = docs.select("text").mapInArrow(run, "term long, " + ", ".join(f"{n} double" for n in names)).groupBy(
        "term").agg(*[F.sum(n).alias(n) for n in names])
    image = np.zeros((TERMS, rank))
    for r in sums.collect():
        image[r["term"]] = [r[n] for n in names]
    image *= idf[:, None]
    core = np.zeros((rank, rank))
    np.add.at(core, column, image * sign[:, None])
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 0) * 1e-6
    if not keep.any():
        return np.zeros((TERMS, 1), np.float32)
    u, s, _ = np.linalg.svd(image @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return (idf[:, None] * u / np.maximum(s, 1e-9)).astype(np.float32)


class Items(NamedTuple):
    """A block of benchmark items: ids, word hashes, answers and latent passages."""

    ids: np.ndarray
    hashes: list[np.ndarray]
    answer: list[int]
    held: np.ndarray
    mass: np.ndarray
    owner: np.ndarray
    latent: np.ndarray
    bar: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def prepare(ids: list[int], texts: list[str], vectors: np.ndarray, idf: np.ndarray) -> Items:
    """Items with their passages; an item of fewer words than a passage is one passage."""
    keep = [(i, t) for i, t in zip(ids, texts) if t and t.strip(" \t\n\r\v\f")]
    hashes, answer, owner, latent, bar = [], [], [], [], []
    held, mass = np.zeros((len(keep), TERMS), bool), np.zeros(len(keep))
    for k, (_, text) in enumerate(keep):
        raw = text.encode()
        w = bw.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)
        term = _terms(w)
        held[k, term], mass[k] = True, idf[term].sum()
        hashes.append(w.hash)
        # The answer begins after the last sentence end before the last word; else it is the last fifth.
        ends = [i for i in range(len(w.start) - 1) if raw[w.end[i] - 1:w.end[i]] in (b".", b"?", b"!", b":")]
        answer.append(ends[-1] + 1 if ends else len(term) - -(-len(term) // 5))
        last = max(0, len(term) - PASSAGE)
        for at in sorted({*range(0, last, ITEM_STEP), last}):
            owner.append(k)
            bar.append(COSINE if len(term) >= PASSAGE else SHORT_COSINE)
            latent.append(vectors[term[at:at + PASSAGE]].sum(axis=0))
    return Items(np.array([i for i, _ in keep], np.int64), hashes, answer, held, mass, np.array(owner, np.int64),
                 _unit(np.array(latent).reshape(len(latent), vectors.shape[1])).astype(np.float32),
                 np.array(bar, np.float32))


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit of an integer per word of ``item``."""
    masks: dict[int, int] = {}
    for i, h in enumerate(item.tolist()):
        masks[h] = masks.get(h, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for h in words.tolist():
        mask = masks.get(h)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def search(data: np.ndarray, offsets: np.ndarray, items: Items, vectors: np.ndarray,
           idf: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(document, item, common words, cosine) of the leaks in a slice; the best window per pair."""
    w = bw.words(data, offsets, lower=True)
    if not len(w.hash) or not len(items.ids):
        return []
    term = _terms(w)
    first, doc, number = _cut(w, STEP)
    block = np.add.reduceat(vectors[term], first, axis=0)
    window = block.copy()
    next_same = np.flatnonzero(doc[1:] == doc[:-1])
    window[next_same] += block[next_same + 1]
    window = _unit(window)
    firsts = w.firsts()
    best: dict[tuple[int, int], tuple[int, float]] = {}
    for low in range(0, len(window), 2048):
        cosine = window[low:low + 2048] @ items.latent.T
        at, passage = np.divmod(np.flatnonzero(cosine >= items.bar), cosine.shape[1])
        if not len(at):
            continue
        pair, where = np.unique((low + at) * len(items.ids) + items.owner[passage], return_inverse=True)
        near = np.zeros(len(pair), np.float32)
        np.maximum.at(near, where, cosine[at, passage])
        at, item = np.divmod(pair, len(items.ids))
        begin = first[at]
        end = np.minimum(begin + PASSAGE, firsts[doc[at] + 1])
        place = begin[:, None] + np.arange(PASSAGE)
        here = term[np.minimum(place, len(term) - 1)]
        weight = idf[here] * (place < end[:, None])
        shared = (items.held[item[:, None], here] * weight).sum(axis=1)
        take = np.flatnonzero(shared >= SHARED * np.minimum(weight.sum(axis=1), items.mass[item]))
        for k in take:
            i, d = int(item[k]), int(doc[at[k]])
            mine = items.hashes[i]
            around = w.hash[max(firsts[d], begin[k] - len(mine)):min(firsts[d + 1], end[k] + len(mine))]
            common = common_subsequence(mine, around)
            if common < PARAPHRASE_SHARE * len(mine):
                continue
            if common < LEAK_SHARE * len(mine):
                answer = mine[items.answer[i]:]
                if common_subsequence(answer, around) < ANSWER_SHARE * len(answer):
                    continue
            if best.get((d, i), (0, 0.0)) < (common, float(near[k])):
                best[d, i] = common, float(near[k])
    return [(d, i, common, cosine) for (d, i), (common, cosine) in best.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS,
          keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, item_id, common_words, item_words, cosine): documents that hold benchmark items.

    ``docs`` has text and the columns ``keys``, which name a row.  Null and empty texts and items match
    nothing; the empty benchmark gives no rows.  Rows that repeat a key are searched each and reported once
    per item, with the most common words; null keys are reported as null.  Words are compared with A-Z
    lower-cased.  Other columns are ignored.
    """
    found = None
    idf = inverse_frequencies(docs)
    vectors = directions(docs, idf)
    rows = docs.select(*keys, "text")
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string(
        "item_id long, common_words long, item_words long, cosine double").fields])
    # The driver collects one block of items after the other; the searches hold theirs until they have run.
    numbered = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).withColumn(
        "part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-benchmark.count() // block_items)))))
    for (part,) in numbered.select("part").distinct().orderBy("part").collect():
        block = numbered.filter(F.col("part") == part).select("item_id", "text").collect()
        items = prepare([r["item_id"] for r in block], [r["text"] for r in block], vectors, idf)
        here = rows.mapInArrow(_finder(items, vectors, idf), schema)
        found = here if found is None else found.union(here)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy(*keys, "item_id", "item_words").agg(
        F.max(F.struct("common_words", "cosine")).alias("best")).select(
        *keys, "item_id", "best.common_words", "item_words", F.col("best.cosine").alias("cosine"))


def _finder(items: Items, vectors: np.ndarray, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for low, _, data, offsets in bw.slices(batch.column(n)):
                rows = search(data, offsets, items, vectors, idf)
                at = pa.array([low + r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(at) for i in range(n)],
                     pa.array([int(items.ids[r[1]]) for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([len(items.hashes[r[1]]) for r in rows], pa.int64()),
                     pa.array([r[3] for r in rows], pa.float64())],
                    names=[*batch.schema.names[:n], "item_id", "common_words", "item_words", "cosine"])
    return run
