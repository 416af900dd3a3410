"""Fill-in-middle transformation on piece tables (operator 12).

A document is a list of descriptors (buffer, start, length) over immutable buffers: its text and the three
sentinels.  Two cuts split the text's descriptor at token borders, an arrangement permutes the descriptors
and puts sentinels between them, and the inverse permutation of the output's descriptors restores the text.
No byte of a text is copied until an output is asked for; digests stream the descriptors.

Every row is transformed on its own inside one narrow pass: nothing is shuffled, and the choices are hashes
of the doc_id, so any retry gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm import bytewords as bw

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1
#: Order of the parts (0 prefix, 1 middle, 2 suffix) and the sentinel before each.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_SENTINEL_OF = {0: PREFIX, 1: MIDDLE, 2: SUFFIX}

_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = True


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, length) in the order in which they are read."""

    buffers: tuple[memoryview, ...]
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: bytes | memoryview) -> PieceTable:
        """One descriptor over the whole text; buffer 1 holds the sentinels."""
        return cls((memoryview(text), memoryview(SENTINELS)), ((0, 0, len(text)),))

    def cut(self, at: int) -> PieceTable:
        """The same bytes with a border at byte ``at``; a border at an end gives an empty piece."""
        pieces, place, done = [], 0, False
        for buffer, start, length in self.pieces:
            if not done and place <= at <= place + length:
                pieces += [(buffer, start, at - place), (buffer, start + at - place, length - (at - place))]
                done = True
            else:
                pieces.append((buffer, start, length))
            place += length
        return PieceTable(self.buffers, tuple(pieces))

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        """Descriptors in a new order."""
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def marked(self, sentinels: tuple[bytes, ...]) -> PieceTable:
        """A sentinel before each descriptor."""
        pieces = []
        for sentinel, piece in zip(sentinels, self.pieces):
            pieces += [(1, SENTINELS.index(sentinel), len(sentinel)), piece]
        return PieceTable(self.buffers, tuple(pieces))

    def unmarked(self) -> PieceTable:
        """Without the descriptors of sentinels."""
        return PieceTable(self.buffers, tuple(p for p in self.pieces if p[0] != 1))

    def read(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def bytes(self) -> bytes:
        return b"".join(self.read())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.read():
            digest.update(part)
        return digest.hexdigest()


def arrange(text: bytes | memoryview, low: int, high: int, form: str) -> PieceTable:
    """Cut ``text`` at the bytes ``low`` <= ``high`` and arrange the three parts; plain stays as it is."""
    table = PieceTable.of(text)
    if form == "plain":
        return table
    order = ARRANGEMENTS[form]
    return table.cut(high).cut(low).arranged(order).marked(tuple(_SENTINEL_OF[i] for i in order))


def restored(output: bytes, form: str) -> PieceTable:
    """The text behind ``output``: its parts are found at the sentinels and permuted back."""
    if form == "plain":
        return PieceTable.of(output)
    order = ARRANGEMENTS[form]
    pieces, place = [], 0
    for k, part in enumerate(order):
        place = output.index(_SENTINEL_OF[part], place) + 3
        end = output.index(_SENTINEL_OF[order[k + 1]], place) if k + 1 < len(order) else len(output)
        pieces.append((0, place, end - place))
        place = end
    inverse = tuple(order.index(i) for i in range(len(order)))
    return PieceTable((memoryview(output), memoryview(SENTINELS)), tuple(pieces)).arranged(inverse)


def _borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each token, first token of each text, code points before each byte)."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(begins)))
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    starts = offsets[:-1][offsets[:-1] < len(data)]
    inner[starts] = False  # a text begins a token
    begin = np.flatnonzero(begins & ~inner)
    return begin, np.searchsorted(begin, offsets), points


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:doc_id``; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def _transform(batches: Iterator[pa.RecordBatch], texts: bool, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in bw.slices(batch.column(1)):
            ids = batch.column(0).slice(low, high - low)
            begin, first, points = _borders(data, offsets)
            raw = memoryview(np.ascontiguousarray(data)) if len(data) else memoryview(b"")
            rows: list[tuple] = []
            for d, doc_id in enumerate(ids.to_pylist()):
                start, end = int(offsets[d]), int(offsets[d + 1])
                text, tokens = bytes(raw[start:end]), begin[first[d]:first[d + 1]]
                n = len(tokens)
                h1, h2, h3, h4 = draws(doc_id, seed)
                cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    form, chars, table = "plain", (None, None), arrange(text, 0, 0, "plain")
                else:
                    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
                    a, b = (int(tokens[c]) - start if c < n else end - start for c in cuts)
                    before, at, after = (int(points[start + x]) for x in (0, a, b))
                    chars, table = (at - before, after - at), arrange(text, a, b, form)
                output = table.bytes()
                rows.append((n, form, *chars, table.sha256(), restored(output, form).sha256(),
                             output.decode() if texts else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=NAMES)


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]


def fill_in_middle(docs: DataFrame, texts: bool = True, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n, form, sizes, digests and the output text.

    n counts tokens (a run of A-Z and a-z, or any other code point).  ``output`` is null unless ``texts``.
    A null text counts as empty; empty texts, texts that hold a sentinel and a tenth of the others are plain,
    with null sizes.  A null doc_id draws like an empty one, repeated rows give equal rows, other columns are
    ignored, and no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        lambda batches: _transform(batches, texts, seed),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
        "restored_sha256 string, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (output, form and more) with restored: the text behind each output.

    Null where output or form is null.  An existing column of that name is replaced.
    """
    kept = rows.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            pairs = zip(batch.column(at["output"]).to_pylist(), batch.column(at["form"]).to_pylist())
            found = [None if o is None or f is None else restored(o.encode(), f).bytes().decode() for o, f in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, "restored"])

    return kept.mapInArrow(run, kept.withColumn("restored", F.lit(None).cast("string")).schema)
