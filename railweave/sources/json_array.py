"""A data source for large JSON arrays, one to a file: byte ranges, each read by its own task.

Spark's own reader takes a file whose array spans lines as one task.  Here the file is cut into ranges of
``split_bytes``; a task owns the objects that begin in its range.  Where an object begins is decided from the
text itself: elements of the outer array are objects at depth one, and whether a byte lies inside a string
depends on all quotes before it, so a first pass counts, range by range, the quotes, brackets and
the state they leave, and each task starts from the sum of the ranges before it.  The pass holds three numbers
per range.  Files must be on a path that all executors can open.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 8 << 20
_MARK = re.compile(rb'[\[\]{}"]')


class Range(InputPartition):
    """Bytes [low, high) of a file, the state they begin in, and the bytes of the files before it."""

    def __init__(self, path: str, low: int, high: int, depth: int, inside: bool, before: int):
        super().__init__((path, low, high, depth, inside, before))


def _quoted_end(data: bytes, at: int) -> int:
    """Place after the string that begins before ``at``; -1 if it does not end in ``data``."""
    while True:
        end = data.find(b'"', at)
        if end < 0:
            return -1
        back = end
        while back > at and data[back - 1] == 0x5C:
            back -= 1
        if (end - back) % 2 == 0:
            return end + 1
        at = end + 1


def scan(data: bytes, inside: bool) -> tuple[int, bool]:
    """(change of depth, whether a string is open at the end) of a piece that begins in or out of a string."""
    at, depth = 0, 0
    if inside:
        at = _quoted_end(data, 0)
        if at < 0:
            return 0, True
    while True:
        met = _MARK.search(data, at)
        if met is None:
            return depth, False
        mark, at = met[0], met.end()
        if mark == b'"':
            at = _quoted_end(data, at)
            if at < 0:
                return depth, True
        else:
            depth += 1 if mark in b"[{" else -1


def _first_object(data: bytes, inside: bool, depth: int) -> int:
    """Place of the first ``{`` of an element of the outer array; -1 without one."""
    at = _quoted_end(data, 0) if inside else 0
    while at >= 0:
        met = _MARK.search(data, at)
        if met is None:
            return -1
        mark, at = met[0], met.end()
        if mark == b'"':
            at = _quoted_end(data, at)
        elif mark in b"[{":
            if mark == b"{" and depth == 1:
                return met.start()
            depth += 1
        else:
            depth -= 1
    return -1


def _piece(path: str, low: int, high: int) -> bytes:
    """Bytes of a range, without a backslash that escapes what follows: cuts move behind it."""
    with open(path, "rb") as file:
        file.seek(low)
        return file.read(high - low)


def cuts(path: str, split_bytes: int) -> list[int]:
    """Borders of the ranges; none stands between a backslash and what it escapes."""
    size = os.path.getsize(path)
    borders = [0]
    with open(path, "rb") as file:
        for at in range(split_bytes, size, split_bytes):
            file.seek(at - 1)
            while file.read(1) == b"\\":
                at += 1
            if borders[-1] < at < size:
                borders.append(at)
    return [*borders, size]


class ArrayReader(DataSourceReader):
    """Options: ``path`` and ``states``, the (range, depth, inside) of one file, or ``files``, several (path, states)."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        files = json.loads(options["files"]) if "files" in options else [(options["path"], json.loads(options["states"]))]
        self.ranges, before = [], 0
        for path, states in files:
            self.ranges += [Range(path, low, high, depth, inside, before) for (low, high), depth, inside in states]
            before += states[-1][0][1]

    def partitions(self) -> list[InputPartition]:
        return self.ranges

    def read(self, partition: Range) -> Iterator[tuple[str, int]]:
        path, low, high, depth, inside, before = partition.value
        data = _piece(path, low, high)
        at = _first_object(data, inside, depth)
        if at < 0:
            return
        decoder = json.JSONDecoder()
        size = os.path.getsize(path)
        end = high
        while 0 <= at < high - low:
            # an object is short as a rule; the last one may run on into the next ranges
            width = 1 << 12
            while True:
                try:
                    text = data[at:at + width].decode("utf-8", errors="ignore")
                    _, length = decoder.raw_decode(text)
                    break
                except json.JSONDecodeError:
                    if at + width < len(data):
                        width *= 4
                        continue
                    if end >= size:
                        raise
                    more = min(size, end + max(self.split, 1 << 16))
                    data += _piece(path, end, more)
                    end, width = more, width * 4
            body = text[:length]
            yield body, before + low + at
            at += len(body.encode("utf-8"))
            rest = re.compile(rb"[\s,]*").match(data, at).end()
            at = rest if data[rest:rest + 1] == b"{" else -1


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "value string, ord long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(schema, self.options)


def array_paths(path: str) -> list[str]:
    """The files of ``path``, a file or a folder, if each is plain text that begins an array; else none."""
    local = re.sub("^file:(//)?", "", path)
    if os.path.isfile(local):
        return [local]
    found = [os.path.join(folder, name) for folder, _, names in os.walk(local) for name in names if name[0] not in "._"]

    def begins(file: str) -> bool:
        with open(file, "rb") as data:
            return data.read(1 << 10).lstrip().startswith(b"[")

    return sorted(found) if all(map(begins, found)) else []


def read_array(spark: SparkSession, path: str | list[str], schema: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of JSON arrays of objects with ``ord``, which rises along the files (the byte an object begins at).

    ``path`` is a local path or file: URI, or a list of them, one array in each.  An empty array gives no rows;
    fields that a row lacks are null.
    """
    paths = [re.sub("^file:(//)?", "", p) for p in ([path] if isinstance(path, str) else path)]
    ranges = [(i, a, b) for i, local in enumerate(paths)
              for borders in [cuts(local, split_bytes)] for a, b in zip(borders, borders[1:]) if a < b]
    if not ranges:
        return spark.createDataFrame([], schema).withColumn("ord", F.lit(None).cast("bigint"))
    asked = spark.createDataFrame(ranges, "file long, low long, high long")

    def states(rows):
        for frame in rows:
            out = []
            for file, low, high in zip(frame["file"], frame["low"], frame["high"]):
                data = _piece(paths[int(file)], int(low), int(high))
                out.append((int(file), int(low), int(high), *scan(data, False), *scan(data, True)))
            yield frame.__class__(out, columns=["file", "low", "high", "plain", "plain_open", "quoted", "quoted_open"])

    found = asked.repartition(min(len(ranges), 200)).mapInPandas(
        states, "file long, low long, high long, plain long, plain_open boolean, quoted long, quoted_open boolean").collect()
    files = []
    for file, group in itertools.groupby(sorted(found, key=lambda r: (r["file"], r["low"])), key=lambda r: r["file"]):
        depth, inside, starts = 0, False, []
        for r in group:
            starts.append(((r["low"], r["high"]), depth, inside))
            depth += r["quoted"] if inside else r["plain"]
            inside = r["quoted_open"] if inside else r["plain_open"]
        files.append((paths[file], starts))
    spark.dataSource.register(ArraySource)
    raw = spark.read.format("json_array").option("split_bytes", split_bytes).option("files", json.dumps(files)).load()
    return raw.select(F.from_json("value", schema).alias("row"), "ord").select("row.*", "ord")
