"""MinHash near-dedup with odd sketches (operator 4).

1. One pass over the texts makes, per document, the size and a 128-bit digest of its shingle set,
   ``BANDS`` band keys of ``ROWS`` MinHash values each, and the odd sketch: every MinHash value toggles one
   of ``BITS`` bits.  The population count of two XORed sketches tells how many values differ.
2. Equal sets form classes; a class has a number of its own, and one of its rows, named by (doc_id, hash of
   the text), lends it the text.
3. Classes that share a band are joined to neighbourhoods by stars on the smallest id of each band, so a
   band met by a third of all documents gives one link per document and never all pairs.
4. A neighbourhood is searched inside tasks of bounded size (``BLOCK`` shingles): a breadth-first walk
   compares a document with those not reached yet, rules most of them out by their sketches, and confirms
   the rest on the full sets.  Only links that join something leave the task.
5. A larger neighbourhood is dealt to several tasks in turn, which joins nearly all of it; what is still
   apart after that meets block by block, without exception.

At a similarity of 0.8 all 45 bands miss a pair with probability (1 - 0.8**6)**45 = 1.2e-6; the bar for
the sketches is a maximum of differing bits, six standard deviations above the expectation at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm import bytewords as bw
from railweave.llm.components import components
from railweave.llm.frames import stored

BANDS, ROWS = 45, 6
BITS = 512
#: Population count of two XORed sketches up to which a similarity of 0.8 is possible.
SKETCH_BAR = 140
BLOCK = 4_000_000
DEALS = 3

_rng = np.random.RandomState(7)
_MULTIPLY = _rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2)
_SEED = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text): distinct ``n``-word shingles of each text, ascending in a text."""
    w = bw.words(data, offsets, lower=True)
    first, value = bw.windows(w.hash, w.doc, n)
    doc = w.doc[first]
    counts, firsts = w.counts(), w.firsts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    value = np.concatenate((value, bw.range_hash(w.hash, firsts[short], firsts[short + 1])))
    doc = np.concatenate((doc, short))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def sketches(value: np.ndarray, starts: np.ndarray, bands: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """(band keys, odd sketches) of non-empty sets that begin at ``starts``."""
    n, k = len(starts), BANDS * ROWS
    short = (value >> np.uint64(32)).astype(np.uint32)
    least = np.empty((k, n), np.uint32)
    for j in range(k):
        np.minimum.reduceat(short * _MULTIPLY[j] + _ADD[j], starts, out=least[j])
    bits = np.zeros((n, BITS), np.uint8)
    samples = bw.mix(least.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))[:, None])
    place, rows = (samples % np.uint64(BITS)).astype(np.int64), np.arange(n)
    for j in range(k):
        bits[rows, place[j]] ^= 1
    keys = None
    if bands:
        keys = np.zeros((n, BANDS), np.uint64)
        for i in range(ROWS):
            keys = bw.mix(keys * _SEED + samples[i::ROWS].T)
    return keys, np.packbits(bits, axis=1)


def _features(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in bw.slices(batch.column(2)):
            value, firsts = shingle_sets(data, offsets, n)
            size = np.diff(firsts)
            full = np.flatnonzero(size)
            one = np.zeros(high - low, np.uint64)
            two = np.zeros(high - low, np.uint64)
            keys, odd = np.zeros((0, BANDS), np.uint64), np.zeros((0, BITS // 8), np.uint8)
            if len(full):
                starts = firsts[:-1][full]
                one[full] = np.add.reduceat(bw.mix(value ^ _SEED), starts)
                two[full] = np.add.reduceat(bw.mix(value + _SEED), starts)
                keys, odd = sketches(value, starts, True)
            has = size > 0
            ends = np.concatenate(([0], np.cumsum(has))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i).slice(low, high - low) for i in (0, 1)], pa.array(size.astype(np.int64)),
                pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(keys.ravel().view(np.int64))),
                pa.Array.from_buffers(pa.binary(), high - low, [
                    None, pa.py_buffer((ends * (BITS // 8)).astype(np.int32).tobytes()),
                    pa.py_buffer(odd.tobytes())]),
            ], names=["doc_id", "text_hash", "n_shingles", "one", "two", "bands", "odd"])


def _walk(ids: np.ndarray, label: np.ndarray, value: np.ndarray, firsts: np.ndarray,
          odd: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the documents of a block as far as their similarities do.

    Documents of one label are joined from the start.  A document that is reached is compared with those
    that are not: sizes and sketches first, then the number of common shingles, counted exactly.
    """
    size = np.diff(firsts)
    _, dense = np.unique(value, return_inverse=True)
    mark = np.zeros(int(dense.max()) + 1 if len(dense) else 1, bool)
    open_ = np.ones(len(ids), bool)
    links = []
    for seed in range(len(ids)):
        if not open_[seed]:
            continue
        same = open_ & (label == label[seed])
        open_[same] = False
        queue = list(np.flatnonzero(same))
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            fits = (100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x]))
            rest = rest[fits]
            rest = rest[np.bitwise_count(odd[rest] ^ odd[x]).sum(axis=1, dtype=np.int64) <= SKETCH_BAR]
            if not len(rest):
                continue
            own = dense[firsts[x]:firsts[x + 1]]
            mark[own] = True
            ends = np.cumsum(size[rest])
            at = np.arange(ends[-1]) + np.repeat(firsts[rest] - (ends - size[rest]), size[rest])
            common = np.add.reduceat(mark[dense[at]].astype(np.int64), ends - size[rest])
            mark[own] = False
            hit = rest[100 * common >= percent * (size[rest] + size[x] - common)]
            for y in hit:
                if open_[y]:
                    links.append((int(ids[x]), int(ids[y])))
                    same = open_ & (label == label[y])
                    open_[same] = False
                    queue.extend(np.flatnonzero(same))
    return links


def _search(n: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = list(bw.slices(pa.array(rows["text"], pa.large_string())))
        values, sizes, odds = [], [], []
        for _, _, data, offsets in parts:
            value, firsts = shingle_sets(data, offsets, n)
            values.append(value)
            sizes.append(np.diff(firsts))
        size = np.concatenate(sizes)
        odds = np.frombuffer(b"".join(rows["odd"]), np.uint64).reshape(len(rows), BITS // 64)
        links = _walk(rows["id"].to_numpy(), rows["label"].to_numpy(), np.concatenate(values),
                      np.concatenate(([0], np.cumsum(size))), odds, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def _links(blocks: DataFrame, keys: list[str], n: int, percent: int) -> DataFrame:
    """Links found inside each block; ``blocks`` has id, label, text, odd and the keys."""
    return blocks.select(*keys, "id", "label", "text", "odd").groupBy(*keys).applyInPandas(
        _search(n, percent), "a long, b long")


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after ``links``: the smallest id reached so far."""
    found = components(links)
    return rows.select("id", "area", "n_shingles", "n_blocks").join(found, "id", "left").select(
        "id", "area", "n_shingles", "n_blocks", F.coalesce("root", "id").alias("label"))


def near_duplicate_links(classes: DataFrame, docs: DataFrame, n: int, percent: int,
                         block: int = BLOCK) -> DataFrame:
    """Links (a, b) between class representatives that join them as far as their similarities do."""
    spark = docs.sparkSession
    keys = classes.select("id", F.posexplode("bands").alias("band", "key"))
    heads = keys.groupBy("band", "key").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter(
        F.col("head") < F.col("last")).drop("last")
    stars = keys.join(heads, ["band", "key"]).filter(F.col("id") != F.col("head")).select(
        F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    areas = stored(components(stars), "areas")
    sizes = classes.select("id", "n_shingles").join(areas, "id").groupBy("root").agg(
        F.ceil(F.sum("n_shingles") / F.lit(block)).alias("n_blocks"))
    members = areas.join(sizes, "root").select("id", F.col("root").alias("area"), "n_blocks")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # Equal rows lend their text once; they lie in one partition after the join.
    rows = classes.select("id", "doc_id", "text_hash", "n_shingles", "odd").join(members, "id").join(
        texts, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).drop("doc_id", "text_hash")
    rows = stored(rows, "near-candidates")
    blocked = rows.withColumn("label", F.col("id")).withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit(0)), "n_blocks"))
    links = stored(_links(blocked, ["area", "block"], n, percent), "near-links")
    wide = rows.filter(F.col("n_blocks") > 1)
    if wide.isEmpty():
        return links
    texts = wide.select("id", "text", "odd")
    for deal in range(1, DEALS):
        labelled = stored(_relabel(wide, links), "near-labels")
        blocked = labelled.join(texts, "id").withColumn(
            "block", F.pmod(F.xxhash64("id", F.lit(deal)), "n_blocks"))
        links = links.union(stored(_links(blocked, ["area", "block"], n, percent), "near-links"))
    labelled = stored(_relabel(wide, links), "near-labels")
    # A label that fills blocks has its own; the others share some.  Blocks of one label need no meeting.
    sized = labelled.groupBy("area", "label").agg(F.sum("n_shingles").alias("total"))
    shared = sized.groupBy("area").agg(
        F.ceil(F.sum(F.when(F.col("total") < block, F.col("total")).otherwise(0)) / F.lit(block)).alias("n_shared"))
    placed = labelled.join(sized, ["area", "label"]).join(shared, "area").select(
        "id", "area", "label",
        F.when(F.col("total") >= block, F.col("label")).alias("owner"),
        F.when(F.col("total") >= block, F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / F.lit(block))))
        .otherwise(F.pmod(F.xxhash64("label"), F.greatest("n_shared", F.lit(1)))).alias("block"))
    placed = stored(placed, "near-blocks")
    one = placed.select("area", F.col("owner").alias("o1"), F.col("block").alias("b1")).distinct()
    two = one.select("area", F.col("o1").alias("o2"), F.col("b1").alias("b2"))
    order = lambda o, b: F.struct(F.coalesce(o, F.lit(-1 << 63)), b)
    pairs = one.join(two, "area").filter(
        (order("o1", "b1") <= order("o2", "b2")) & ~(F.col("o1").eqNullSafe(F.col("o2")) & F.col("o1").isNotNull())
    ).withColumn("pair", F.monotonically_increasing_id())
    pairs = stored(pairs, "near-pairs")
    sides = pairs.select("pair", "area", F.col("o1").alias("owner"), F.col("b1").alias("block")).union(
        pairs.select("pair", "area", "o2", "b2")).distinct()
    meet = (placed["area"] == sides["area"]) & (placed["block"] == sides["block"]) & placed[
        "owner"].eqNullSafe(sides["owner"])
    met = placed.join(sides, meet).select("pair", "id", "label").join(texts, "id")
    return links.union(stored(_links(met, ["pair"], n, percent), "near-links"))


def judged(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with text_hash (xxhash64 of the text), which tells rows of one doc_id apart."""
    if percent < 80:
        raise ValueError("bands and sketches are laid out for 80 % or more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    features = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        lambda batches: _features(batches, shingle),
        "doc_id long, text_hash long, n_shingles long, one long, two long, bands array<long>, odd binary"), "near-features")
    filled = features.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = filled.groupBy("one", "two").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    here = F.struct("doc_id", "text_hash")
    # The numbers are fixed as soon as the classes are written.
    classes = stored(filled.join(sets, ["one", "two"]).filter(here == F.col("head")).drop("head").dropDuplicates(
        ["one", "two"]).withColumn("id", F.monotonically_increasing_id()), "near-classes")
    links = near_duplicate_links(classes, docs, shingle, percent, block)
    roots = components(links)
    rooted = stored(classes.select("id", "doc_id", "one", "two").join(roots, "id", "left").select(
        "doc_id", "one", "two", F.coalesce("root", "id").alias("root")), "near-roots")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(least, "root").select("one", "two", "component_id")
    found = filled.select("doc_id", "text_hash", "n_shingles", "one", "two").join(of_class, ["one", "two"]).select(
        "doc_id", "text_hash", "n_shingles", "component_id")
    alone = features.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at x20 and x09-x0D; documents are linked if
    100 * common >= ``percent`` * united shingles of ``shingle`` words, on whole texts and full sets, and
    components follow links.  ``percent`` must be 80 or more, for which bands and sketches are laid out.
    A text of fewer words is one shingle; null and empty texts have none and stay alone.  Equal texts are
    linked.  A row without doc_id is linked with nothing: component_id null, kept true.  Rows that repeat
    a doc_id are judged each by its own text.  Other columns are ignored; no rows give no rows.
    """
    return judged(docs, shingle, percent, block).drop("text_hash")
