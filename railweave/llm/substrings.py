"""Substring dedup by difference-cover anchors (operator 9).

Two equal windows of ``WINDOW`` words share an aligned anchor: D = {0, 1, 3, 9} holds every difference
modulo 13, so for starts i and j some shift below 13 puts both i + shift and j + shift on positions whose
remainder is in D.  Hence only 4 of 13 positions send the hash of their 8-word anchor over the wire
(12 + 8 = 20 words).  Anchors met only once rule out all windows around them.  The windows that keep a
repeated anchor are then extended to their full 20 words, and those sequences are compared by 96 bits.

Hot passages: every task settles repetitions inside its own slice of texts first.  It sends one
representative of a sequence on; the other occurrences are known repetitions and travel under keys of
their own, so the task that compares a passage meets one row per slice that holds it, not one per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm import bytewords as bw
from railweave.llm.frames import count_words, stored

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: A row without an id comes after all others.
NO_ID = (1 << 63) - 1

#: Copies of one row that a task writes at once.
COPIES = 10_000

_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _settle(key: np.ndarray, own: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, known): one representative per key, and the other rows of it as known repetitions.

    ``order`` lists the rows from the earliest; the representative is the earliest.  ``own`` are keys that
    are each row's own.
    """
    by_key = order[np.argsort(key[order], kind="stable")]
    first = np.ones(len(by_key), bool)
    first[1:] = key[by_key][1:] != key[by_key][:-1]
    return by_key, np.where(first, key[by_key], own[by_key]), ~first


def _own(key: np.ndarray, rid: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that are each row's own."""
    row = rid.astype(np.uint64) * np.uint64(0x100000001B3) + bw.mix(tie.astype(np.uint64))
    return bw.mix(key ^ bw.mix(row + place.astype(np.uint64)))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for low, high, data, offsets in bw.slices(batch.column(2)):
            w = bw.words(data, offsets)
            long_enough = w.counts() >= WINDOW
            at, key = bw.windows(w.hash, w.doc, ANCHOR)
            firsts = w.firsts()
            place = at - firsts[w.doc[at]]
            take = _ON_COVER[place % PERIOD] & long_enough[w.doc[at]]
            at, key, place = at[take], key[take], place[take]
            if not len(at):
                continue
            rid, tie = ids[low:high][w.doc[at]], ties[low:high][w.doc[at]]
            own = _own(key, rid, tie, place)
            row, sent, known = _settle(key, own, np.arange(len(at)))
            # The representative of a key met twice here is a repetition too; it is sent once more as known.
            twin = np.flatnonzero(~known[:-1] & known[1:]) if len(row) > 1 else np.zeros(0, int)
            row = np.concatenate((row, row[twin]))
            sent = np.concatenate((sent, own[row[len(sent):]]))
            known = np.concatenate((known, np.ones(len(twin), bool)))
            place = place[row] * 2 + known
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.view(np.int64)), pa.array(rid[row]), pa.array(tie[row]), pa.array(place.astype(np.int64))],
                names=["key", "rid", "tie", "place"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around a repeated anchor, with the hash of all their words."""
    for batch in batches:
        ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        marks = batch.column(3)
        for low, high, data, offsets in bw.slices(batch.column(2)):
            w = bw.words(data, offsets)
            firsts = w.firsts()
            at, one = bw.windows(w.hash, w.doc, WINDOW)
            if not len(at):
                continue
            part = marks.slice(low, high - low)
            places = np.asarray(part.flatten())
            doc = np.repeat(np.arange(high - low), np.asarray(part.value_lengths().fill_null(0), dtype=np.int64))
            inside = firsts[doc] + places < firsts[doc + 1]
            places, doc = places[inside], doc[inside]
            hit = np.zeros(len(w.hash) + 1, np.int64)
            hit[firsts[doc] + places + 1] = 1
            hit = np.cumsum(hit)
            take = hit[at + PERIOD] > hit[at]  # an anchor at one of the first 13 words
            at, one = at[take], one[take]
            if not len(at):
                continue
            two = bw.range_hash(bw.words(data, offsets, table=1).hash, at, at + WINDOW)
            rid, tie = ids[low:high][w.doc[at]], ties[low:high][w.doc[at]]
            place = at - firsts[w.doc[at]]
            both = bw.mix(one) ^ two
            own = _own(both, rid, tie, place)
            row, sent, known = _settle(both, own, np.lexsort((place, tie, rid)))
            info = (np.where(known, own[row], one[row]) >> np.uint64(32) << np.uint64(32)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.view(np.int64)), pa.array(rid[row]), pa.array(tie[row]),
                 pa.array(info | place[row] << 1 | known)],
                names=["key", "rid", "tie", "info"])


def _kept(batches: Iterator[pa.RecordBatch], texts_too: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digest, texts = [], [], [], []
        marks = batch.column(1)
        for low, high, data, offsets in bw.slices(batch.column(0)):
            w = bw.words(data, offsets)
            firsts = w.firsts()
            part = marks.slice(low, high - low)
            places = np.asarray(part.flatten())
            doc = np.repeat(np.arange(high - low), np.asarray(part.value_lengths().fill_null(0), dtype=np.int64))
            inside = firsts[doc] + places + WINDOW <= firsts[doc + 1]
            places, doc = places[inside], doc[inside]
            edge = np.zeros(len(w.hash) + WINDOW + 1, np.int64)
            np.add.at(edge, firsts[doc] + places, 1)
            np.add.at(edge, firsts[doc] + places + WINDOW, -1)
            gone = np.cumsum(edge)[:len(w.hash)] > 0
            removed = np.concatenate(([0], np.cumsum(gone)))
            # Bytes of kept words, each followed by one space; the last space of a text is cut.
            keep = ~gone
            start, size = w.start[keep], w.end[keep] - w.start[keep] + 1
            ends = np.cumsum(size)
            source = np.arange(int(ends[-1]) if len(ends) else 0)
            if len(ends):
                source += np.repeat(start - (ends - size), size)
                out = data[np.minimum(source, len(data) - 1)]
                out[ends - 1] = 32
            else:
                out = np.zeros(0, np.uint8)
            border = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(keep)))[firsts]]
            for d in range(high - low):
                kept = out[border[d]:max(border[d], border[d + 1] - 1)].tobytes()
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if texts_too else None)
                n_words.append(int(firsts[d + 1] - firsts[d]))
                n_removed.append(int(removed[firsts[d + 1]] - removed[firsts[d]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(digest, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents under keys of their own, rows too short to lose a word, and later copies of documents.

    The key (rid, tie) of a document sorts as (doc_id, null last; hash of the text; number).  Rows whose
    doc_id is theirs alone have tie 0.  Others are stored once per (doc_id, text) with their tie; a later
    copy (doc_id, tie, n_words, copies) loses all its words, so it is only counted.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = rows.filter(F.col("doc_id").isNotNull())
    shared = stored(named.groupBy("doc_id").count().filter(F.col("count") > 1).select("doc_id"), "shared-ids")
    others = named.join(shared, "doc_id", "left_semi").select("doc_id", "text").unionByName(
        rows.filter(F.col("doc_id").isNull())).withColumn("n_words", count_words(F.col("text")))
    texts = others.filter(F.col("n_words") >= WINDOW).groupBy("doc_id", "text", "n_words").agg(
        F.count(F.lit(1)).alias("n")).withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 17))
    number = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("text"))
    apart = stored(texts.withColumn("tie", F.shiftleft("hash", 16) + number).drop("hash"), "texts-of-shared-ids")
    alone = named.join(shared, "doc_id", "left_anti").select(
        F.col("doc_id").alias("rid"), F.lit(0).cast("bigint").alias("tie"), "text", "doc_id")
    whole = alone.unionByName(apart.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "tie", "text", "doc_id"))
    copies = apart.filter(F.col("n") > 1).select(
        "doc_id", "tie", "n_words", (F.col("n") - 1).alias("copies"))
    return whole, others.filter(F.col("n_words") < WINDOW).select("text", "doc_id"), copies


def repeated_windows(whole: DataFrame) -> DataFrame:
    """(rid, tie, place): starts of windows whose word sequence also starts earlier."""
    ids = whole.select("rid", "tie", "text")
    anchors = ids.filter(F.col("text").isNotNull()).mapInArrow(_anchors, "key long, rid long, tie long, place long")
    repeated = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter(
        (F.col("n") > 1) | (F.col("place") % 2 == 1))
    marks = stored(repeated.groupBy("rid", "tie").agg(F.collect_set(F.expr("place div 2")).alias("places")), "marks")
    # info: 32 bits of a second hash, the start, and whether the window is a known repetition.
    windows = ids.join(marks, ["rid", "tie"]).select("rid", "tie", "text", "places").mapInArrow(
        _candidates, "key long, rid long, tie long, info long").repartition("key")
    windows = windows.select("key", "rid", "tie", F.shiftright("info", 32).alias("check"), F.expr(
        "(info & 4294967295) div 2").alias("place"), (F.col("info") % 2 != 0).alias("known"))
    here = F.struct("rid", "tie", "place")
    earliest = F.min(here).over(Window.partitionBy("key", "check"))
    return windows.withColumn("earliest", earliest).filter(
        F.col("known") | (here > F.col("earliest"))).select("rid", "tie", "place")


def dedup_substrings(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Remove each word covered by a window of 20 words that also starts earlier.

    ``docs`` has doc_id and text; other columns are ignored.  Returns doc_id, n_words, n_removed,
    kept_sha256 and kept_text (null unless ``texts``), one row per row of ``docs``.  Null and empty texts have no words and keep
    the digest of nothing.  Earlier means a smaller doc_id (null: after all others), or an earlier start in
    the same row; each row is a document of its own, and rows of one doc_id (or of none) come in the order of
    the hashes of their texts, of which equal texts keep one.  No rows give no rows.
    """
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    whole, short, copies = keyed(docs)
    windows = stored(repeated_windows(whole), "repeated-windows")
    gone = windows.groupBy("rid", "tie").agg(F.collect_set("place").alias("places"))
    cut = whole.join(gone, ["rid", "tie"], "left").select("text", "places", "doc_id").unionByName(
        short.select("text", F.lit(None).cast("array<bigint>").alias("places"), "doc_id")).mapInArrow(
        lambda batches: _kept(batches, texts), fields)
    # The copies of a row are dealt out in parts, so that no task writes all of them.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = copies.withColumn("part", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {COPIES}")))).repartition(tasks, "tie", "part")
    each = part.withColumn("copy", F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.least(F.lit(COPIES).cast("bigint"), F.col("copies") - F.col("part") * COPIES))))
    return cut.unionByName(each.select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"),
        F.lit("" if texts else None).cast("string").alias("kept_text")))
