"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 3).

Statistics come from the bytes of whole texts in Arrow batches and are written once; trees are grown on
binned statistics of a bounded labelled sample and flattened into one array per field, so scoring walks
all trees for all rows of a batch with a few numpy gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm import bytewords as bw
from railweave.llm.frames import stored
from railweave.llm.labelled import crc_rest, labelled_rows, labelled_sample

#: Labelled documents per label value that are used for the fit at most.
TRAIN_PER_LABEL = 10_000
BINS, DEPTH, TREES, RATE, LEAF_PENALTY, LEAF_WEIGHT = 64, 4, 80, 0.15, 1.0, 2.0
BAR = 0.3

CLASSES = {
    "symbols": "#*$%&|<>", "pipes": "|", "exclaims": "!", "stops": ".,;:?", "quotes": "\"'()[]{}",
    "digits": "0123456789", "uppers": "".join(map(chr, range(65, 91))), "breaks": "\n", "spaces": " \t\r\v\f",
    "slashes": "/\\@_=~^`+",
}
_TABLES = {}
for _name, _chars in CLASSES.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][[ord(c) for c in _chars]] = True
_TABLES["high"] = np.arange(256) >= 128
STATISTICS = ["log_bytes", "log_words", "word_length", "long_words", "distinct_words", "repeated_triples",
              "repeated_lines", "line_words", "marked_words", *_TABLES]


def _repeats(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document, how many values have occurred before in it."""
    order = np.lexsort((value, doc))
    same = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(document, statistic); all 0 without text."""
    n = len(offsets) - 1
    w = bw.words(data, offsets)
    size, words = np.diff(offsets), w.counts()
    some, long = np.maximum(size, 1), w.end - w.start
    filled = np.maximum(words, 1)
    _, triples = bw.windows(w.hash, w.doc, 3)
    first, _ = bw.windows(w.hash, w.doc, 3)
    cut = data == 10
    begin = np.unique(np.concatenate((offsets[:-1][size > 0], np.flatnonzero(cut) + 1)))
    begin = begin[begin < len(data)]
    owner = np.searchsorted(offsets, begin, "right") - 1
    breaks = np.flatnonzero(cut)
    at = np.searchsorted(breaks, begin)
    end = np.where(at < len(breaks), breaks[np.minimum(at, len(breaks) - 1)] if len(breaks) else 0, len(data))
    end = np.minimum(end, offsets[owner + 1])
    has = end > begin
    begin, end, owner = begin[has], end[has], owner[has]
    lines = bw.span_hash(data, begin, end)
    n_lines = np.maximum(np.bincount(owner, minlength=n), 1)
    # Words that end in a symbol or an exclamation mark.
    last = data[np.maximum(w.end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    marked = np.bincount(w.doc[(_TABLES["symbols"] | _TABLES["exclaims"])[last]], minlength=n)
    columns = [np.log1p(size), np.log1p(words), np.bincount(w.doc, weights=long, minlength=n) / filled,
               np.bincount(w.doc[long > 20], minlength=n) / filled,
               1 - _repeats(w.hash, w.doc, n) / filled, _repeats(triples, w.doc[first], n) / filled,
               _repeats(lines, owner, n) / n_lines, words / n_lines, marked / filled]
    for table in _TABLES.values():
        sums = np.concatenate(([0], np.cumsum(table[data])))
        columns.append((sums[offsets[1:]] - sums[offsets[:-1]]) / some)
    return np.stack(columns, axis=1).astype(np.float32)


class Forest:
    """Complete trees of depth ``DEPTH`` in arrays (tree, node): feature, bar and, below, leaf values."""

    def __init__(self, base: float, feature: np.ndarray, bar: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.bar, self.leaf = base, feature, bar, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Odds of label 1 of each row; walks one level of all trees at a time."""
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return 1 / (1 + np.exp(-out))
        tree = np.arange(len(self.feature))[None, :]
        for low in range(0, len(x), 4096):
            part = x[low:low + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(DEPTH):
                right = part[rows, self.feature[tree, node]] > self.bar[tree, node]
                node = 2 * node + 1 + right
            out[low:low + 4096] += self.leaf[tree, node - (2 ** DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Grow the trees level by level from histograms of gradients; without labels the score is 1/2.

    ``weight`` says how many labelled rows a row of the sample stands for; only the proportions count.
    """
    empty = np.zeros((0, 2 ** DEPTH - 1))
    if not len(y):
        return Forest(0.0, empty.astype(int), empty, np.zeros((0, 2 ** DEPTH)))
    weight = weight / weight.mean()
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    n, f = x.shape
    bars = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(bars[j], x[:, j], "left") for j in range(f)], axis=1)
    cells = (binned + np.arange(f) * BINS).astype(np.int64)
    margin = np.full(n, base)
    features, tops, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature = np.zeros(2 ** DEPTH - 1, np.int64)
        top = np.full(2 ** DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            nodes, offset = 2 ** depth, 2 ** depth - 1
            flat = (node[:, None] * (f * BINS) + cells).ravel()
            shape = (nodes, f, BINS)
            left_g = np.bincount(flat, np.repeat(g, f), nodes * f * BINS).reshape(shape).cumsum(axis=2)
            left_h = np.bincount(flat, np.repeat(h, f), nodes * f * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = (left_g ** 2 / (left_h + LEAF_PENALTY) + right_g ** 2 / (right_h + LEAF_PENALTY)
                    - all_g ** 2 / (all_h + LEAF_PENALTY))
            gain[(left_h < LEAF_WEIGHT) | (right_h < LEAF_WEIGHT)] = 0
            for j in range(f):
                gain[:, j, len(bars[j]):] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for i in range(nodes):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-6:
                    feature[offset + i], top[offset + i] = j, bars[j][b]
            at = offset + node
            node = 2 * node + (x[np.arange(n), feature[at]] > top[at])
        sums_g, sums_h = np.bincount(node, g, 2 ** DEPTH), np.bincount(node, h, 2 ** DEPTH)
        leaf = -RATE * sums_g / (sums_h + LEAF_PENALTY)
        margin += leaf[node]
        features.append(feature)
        tops.append(top)
        leaves.append(leaf)
    return Forest(base, np.stack(features), np.stack(tops), np.stack(leaves))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in bw.slices(batch.column(1)):
                table = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *[pa.array(c) for c in table.T.copy()]],
                    names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} float" for c in STATISTICS))


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (odds of label 1) and predicted of every row of ``docs``.

    Labels (doc_id, quality) of documents whose crc32 mod 5 is 0 are never read; null labels are left out.
    Null and empty texts have all statistics 0 and get the score of these.  A row without doc_id is scored
    and not held out.  Other columns are ignored, repeated rows are scored each; no rows give no rows, and
    without labels every score is 1/2.  Sampled rows weigh as much as all rows with their label that may be
    read, so scores do not depend on the mix of the sample.
    """
    rows = stored(measured(docs), "statistics")
    allowed = crc_rest(F.col("doc_id"), 5) != 0
    sample = labelled_sample(rows, labels, "quality", allowed, per_label, ["doc_id", *STATISTICS]).orderBy("doc_id", *STATISTICS).toArrow()
    x = np.stack([sample.column(c).to_numpy() for c in STATISTICS], axis=1)
    counts = labelled_rows(rows, labels, "quality", allowed)
    y = sample.column("y").to_numpy()
    values, at, seen = np.unique(y, return_inverse=True, return_counts=True)
    weight = np.array([counts[v] for v in values.tolist()], float) / seen
    forest = fit(x, (y > 0).astype(float), weight[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(crc_rest(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= BAR).cast("int").alias("predicted"))
