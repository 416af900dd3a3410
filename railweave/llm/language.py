"""Language ID by a linear-chain conditional random field (operator 7).

Every word gets an emission per language from hashed features: the lower-cased word itself (lexicon),
prefixes and suffixes of one to three bytes, and all trigrams.  Learned transitions tie neighbouring words,
and forward-backward turns both into the odds of each language for each word of a piece of ``PIECE`` words,
so a text may switch.  A document takes the language with the most expected words.

The field is trained by full gradients on a bounded sample; half of its pieces join two documents, so that
switches occur in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm import bytewords as bw
from railweave.llm.frames import append_columns
from railweave.llm.labelled import crc_rest, labelled_sample

BUCKETS = 1 << 16
AFFIXES = (1, 2, 3)
PIECE = 64
#: Documents per language that are used for the fit at most.
TRAIN_PER_LANG = 150
STEPS, RATE, PENALTY = 30, 0.3, 1e-6
UNKNOWN = "und"

_LOW = np.arange(256, dtype=np.uint64)
_LOW[ord("A"):ord("Z") + 1] += np.uint64(32)


class Vocabulary:
    """Distinct words of a batch with the buckets of their features."""

    def __init__(self, w: bw.Words):
        _, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        start, end = w.start[at], w.end[at]
        columns = [w.hash[at]]
        for k in AFFIXES:
            salt = np.uint64(k * 2)
            columns.append(bw.span_hash(w.data, start, np.minimum(start + k, end), True) + salt)
            columns.append(bw.span_hash(w.data, np.maximum(end - k, start), end, True) + salt + np.uint64(1))
        self.fixed = [(bw.mix(c) % np.uint64(BUCKETS)).astype(np.int64) for c in columns]
        n = np.maximum(end - start - 2, 0)
        self.full = np.flatnonzero(n)
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)
        low = _LOW[w.data]
        code = low[place] << np.uint64(16) | low[place + 1] << np.uint64(8) | low[place + 2] if len(place) else np.zeros(0, np.uint64)
        self.grams = (bw.mix(code + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64)
        self.first = (ends - n)[self.full]
        self.n_grams = n
        self.size = len(at)

    def emit(self, weights: np.ndarray) -> np.ndarray:
        """Emissions (word, language)."""
        out = weights[self.fixed[0]]
        for bucket in self.fixed[1:]:
            out = out + weights[bucket]
        if len(self.full):
            out[self.full] += np.add.reduceat(weights[self.grams], self.first, axis=0)
        return out

    def spread(self, slope: np.ndarray) -> np.ndarray:
        """The gradient of the weights from that of the emissions."""
        out = np.zeros((BUCKETS, slope.shape[1]))
        by_gram = np.repeat(np.arange(self.size), self.n_grams)
        for c in range(slope.shape[1]):
            total = np.bincount(self.grams, weights=slope[by_gram, c], minlength=BUCKETS)
            for bucket in self.fixed:
                total += np.bincount(bucket, weights=slope[:, c], minlength=BUCKETS)
            out[:, c] = total
        return out


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(odds, expected transitions, log of the normaliser) of pieces ``emit`` (piece, place, language).

    Places from ``size`` on are padding.
    """
    n, width, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, t = np.exp(emit - top), np.exp(trans)
    inside = np.arange(width)[None, :] < size[:, None]
    alpha = np.empty_like(e)
    scale = np.ones((n, width), e.dtype)
    a = e[:, 0] / k
    for i in range(width):
        if i:
            a = np.where(inside[:, i, None], (alpha[:, i - 1] @ t) * e[:, i], alpha[:, i - 1])
        s = a.sum(axis=1)
        scale[:, i] = np.where(inside[:, i], s, 1)
        alpha[:, i] = a / s[:, None]
    odds = np.empty_like(e)
    pairs = np.zeros((k, k))
    beta = np.ones((n, k), e.dtype)
    for i in range(width - 1, -1, -1):
        odds[:, i] = alpha[:, i] * beta
        odds[:, i] /= odds[:, i].sum(axis=1, keepdims=True)
        if i:
            back = e[:, i] * beta / scale[:, i, None]
            use = inside[:, i]
            pairs += (alpha[:, i - 1][use].T @ back[use]) * t
            beta = np.where(use[:, None], back @ t.T, beta)
    odds[~inside] = 0
    log = float((np.log(scale) + top[:, :, 0])[inside].sum())
    return odds, pairs, log


def _pieces(doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, size) of the pieces of at most ``width`` words of each document."""
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    n = -(-counts // width)
    owner = np.repeat(np.arange(n_docs), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = firsts[owner] + number * width
    return first, np.minimum(width, firsts[owner + 1] - first)


def fit(texts: pa.Array, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) from texts and the number of the language of each."""
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    data = np.frombuffer(b"".join(t.as_py().encode() + b" " for t in texts.fill_null("")), np.uint8)
    lengths = [len((t.as_py() or "").encode()) + 1 for t in texts]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    w = bw.words(data, offsets, lower=True, letters=True)
    if not len(w.start):
        return weights, trans
    v = Vocabulary(w)
    half = PIECE // 2
    first, size = _pieces(w.doc, w.n_docs, half)
    rng = np.random.RandomState(5)
    mixed = rng.permutation(len(first))
    order = np.arange(len(first))
    order[len(order) // 2:] = mixed[mixed >= len(order) // 2][:len(order) - len(order) // 2]
    pair = order[:len(order) // 2 * 2].reshape(-1, 2)
    rows = np.full((len(pair), PIECE), -1)
    for side in (0, 1):
        begin = np.zeros(len(pair), int) if side == 0 else size[pair[:, 0]]
        for j in range(half):
            use = np.flatnonzero(j < size[pair[:, side]])
            rows[use, begin[use] + j] = first[pair[use, side]] + j
    length = (rows >= 0).sum(axis=1)
    rows, length = rows[length > 0], length[length > 0]
    if not len(rows):
        return weights, trans
    inside = rows >= 0
    word = v.word[np.maximum(rows, 0)]
    label = y[w.doc[np.maximum(rows, 0)]]
    truth = np.zeros((v.size, k))
    np.add.at(truth, (word[inside], label[inside]), 1)
    both = inside[:, 1:] & inside[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (label[:, :-1][both], label[:, 1:][both]), 1)
    total = inside.sum()
    square, square_t = np.zeros_like(weights), np.zeros_like(trans)
    for _ in range(STEPS):
        emit = v.emit(weights)
        odds, pairs, _ = forward_backward(emit[word], length, trans)
        expect = np.stack([np.bincount(word[inside], weights=odds[inside][:, c], minlength=v.size) for c in range(k)], 1)
        slope = v.spread(truth - expect) / total - PENALTY * weights
        slope_t = (seen - pairs) / total - PENALTY * trans
        square += slope * slope
        square_t += slope_t * slope_t
        weights += RATE * slope / (np.sqrt(square) + 1e-8)
        trans += RATE * slope_t / (np.sqrt(square_t) + 1e-8)
    return weights, trans


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights, transitions) from a bounded sample of documents that are not held out."""
    known = docs.select("doc_id", "lang")
    sample = labelled_sample(docs.select("doc_id", "text"), known, "lang", crc_rest(F.col("doc_id"), 5) != 0,
                             per_lang, ["doc_id", "text"]).orderBy("doc_id", "text").toArrow()
    langs = sorted(set(sample.column("y").to_pylist()))
    y = np.array([langs.index(v) for v in sample.column("y").to_pylist()], np.int64)
    texts = sample.column("text").combine_chunks()
    return langs, *fit(texts, y, len(langs))


def identify(texts: pa.Array, langs: list[str], weights: np.ndarray, trans: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, share of expected words) of each text."""
    names: list[str] = []
    scores = np.zeros(len(texts))
    for low, high, data, offsets in bw.slices(texts):
        w = bw.words(data, offsets, lower=True, letters=True)
        shares = np.zeros((high - low, max(1, len(langs))))
        if len(w.start) and langs:
            v = Vocabulary(w)
            emit = v.emit(weights)
            first, size = _pieces(w.doc, w.n_docs, PIECE)
            for at in range(0, len(first), 512):
                f, s = first[at:at + 512], size[at:at + 512]
                rows = np.minimum(f[:, None] + np.arange(PIECE), len(w.start) - 1)
                odds, _, _ = forward_backward(emit[v.word[rows]], s, trans)
                np.add.at(shares, w.doc[f], odds.sum(axis=1))
        counts = w.counts()
        plain = np.concatenate(([0], np.cumsum(bw.LETTER[data] & (data < 128))))[offsets]
        for d in range(high - low):
            lettered = plain[d + 1] > plain[d] or counts[d] and any(
                c.isalpha() for c in data[offsets[d]:offsets[d + 1]].tobytes().decode(errors="replace"))
            if not lettered or not langs:
                names.append(UNKNOWN)
                continue
            best = int(shares[d].argmax())
            names.append(langs[best])
            scores[low + d] = min(1.0, float(shares[d][best]) / max(1, counts[d]))
    return names, scores


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    The languages of documents whose crc32 mod 5 is 0 are never read.  Null texts and texts without a
    letter are ``und`` with score 0, and so is everything if no language is known.  A row without doc_id is
    judged and not held out.  Other columns are ignored; no rows give no rows.
    """
    langs, weights, trans = train(docs)
    small = weights.astype(np.float32)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        names, scores = identify(batch.column(1), langs, small, trans)
        return [pa.array(names, pa.string()), pa.array(scores)]

    return append_columns(docs.select("doc_id", "text"), make, [("lang_pred", "string"), ("score", "double")]).select(
        "doc_id", F.coalesce(crc_rest(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
