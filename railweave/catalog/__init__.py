"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railweave.operators.scale import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; counts come out as bigint whatever Spark's function returned."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(spark, sf_dir)
            small = [f.name for f in result.schema.fields
                     if isinstance(f.dataType, (T.IntegerType, T.ShortType))]
            return result.withColumns({c: F.col(f"`{c}`").cast("bigint") for c in small}
                                      ) if small else result

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the texts, which cost CPU per byte, are dealt out to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def load() -> None:
    """Import all query modules."""
    from railweave.catalog import (  # noqa: F401
        evaluation, files, logs, network, places, texts, training,
    )
