"""Helpers of the operators: shared tables, fresh column names, numbers of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railweave.operators.scale import Stage

#: Whitespace between words, as a Java character class and as its complement.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark drops the shuffle files of a finished query; the written table is all that is read later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, safe from lost executors."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return Stage(df.sparkSession, name).save(df)
    finally:
        conf.set(CLEANUP, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def count_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]],
                   fields: list[tuple[str, str]]) -> DataFrame:
    """Add columns that ``make`` derives from each Arrow batch; rows stay where they are."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, _type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = make(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new],
                                             names=[*batch.schema.names, *[n for n, _ in fields]])

    return df.mapInArrow(run, schema)


def _type(name: str) -> T.DataType:
    return T._parse_datatype_string(name)
