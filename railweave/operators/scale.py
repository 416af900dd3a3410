"""Building blocks that keep hot groups from ending up in one task."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="railweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Stage:
    """Tables written between the rounds of a loop.

    A written table cuts the lineage, survives the loss of executors and is computed
    once, whereas a checkpoint computes its input twice.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{self.written:05d}"
        self.written += 1
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins by shuffles on both sides.

    Spark decides for a broadcast by the size of the files, which are compressed: names and keys that rise
    take a tenth of what they take in memory, so a table of a million rows would go through the driver.
    """
    return df.hint("merge")


def hash_key(seed: int, *parts: Column) -> Column:
    """A repeatable, engine-neutral random sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(seed: int, *parts: Column) -> Column:
    """32 random bits as a bigint."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    """A repeatable uniform number in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(4294967296.0)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
    number: str = "rn", size: str = "n",
) -> DataFrame:
    """Exact row numbers and group sizes without one task per group.

    ``bucket`` must rise with ``order``: rows are numbered inside (group, bucket), and
    each bucket starts where the counts of the buckets before it end.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    group = Window.partitionBy(*keys)
    starts = counts.select(
        *keys, "_bucket",
        (F.sum("_count").over(group.orderBy("_bucket")) - F.col("_count")).alias("_start"),
        F.sum("_count").over(group).alias(size),
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_local", F.row_number().over(local)).alias("t")
    starts = starts.alias("s")
    same = F.lit(True)
    for key in [*keys, "_bucket"]:
        same = same & F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}"))
    return numbered.join(starts, same).select(
        *[F.col(f"t.{c}").alias(c) for c in df.columns],
        (F.col("t._local") + F.col("s._start")).alias(number), F.col(f"s.{size}").alias(size))


def padded(key: Column, width: int, fill: str = "0") -> Column:
    """``key`` as text of at least ``width`` characters; a longer one stays whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), fill)


def hash_bucket(key: Column, digits: int = 2) -> Column:
    """Leading hex digits of a ``hash_key``: they rise with it and hold equal shares."""
    return F.substring(key, 1, digits)


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """Give CPU-heavy work at least one task per core.

    A large input that already comes in many even splits is left alone.  Splits are cut by bytes, but a
    file is read by whole row groups: of many splits of one file a single one may hold all rows.  So rows are
    counted by split, which needs file footers only, and an input is dealt out if it has fewer splits than cores
    or its fullest split holds more than 1.5 times the share of a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        fullest, rows = splits.agg(F.max("n"), F.sum("n")).first()
        if rows is None or 2 * fullest * cores <= 3 * rows:
            return df
    return df.repartition(cores * tasks_per_core)


def in_ranges(df: DataFrame, group: str, position: str, tie: Sequence[str],
              ranges: int | None = None) -> DataFrame:
    """``df`` stored with ``_range``, the number of the range of (group, position, tie) a row lies in.

    Ranges follow each other without overlap and hold about equal numbers of rows, however
    rows bunch.  They are written before use, so that no later pass sees other bounds.
    """
    order = [group, position, *tie]
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return Stage(df.sparkSession, "ranges").save(dealt.withColumn("_range", F.spark_partition_id()))


def with_neighbour(ranged: DataFrame, group: str, position: str, tie: Sequence[str],
                   carry: Sequence[str], offset: int, prefix: str) -> DataFrame:
    """Add the previous (-1) or next (+1) row's ``carry`` columns along ``position``.

    ``ranged`` comes from ``in_ranges``.  The window runs inside (group, range).  Ranges follow each other, so
    only the group at the edge of a range goes on in the next one: the outermost row of each range, one row
    per range, is all that has to cross.
    """
    order = [position, *tie]
    shift = F.lag if offset < 0 else F.lead
    row = F.struct(*order, *[c for c in carry if c not in order])
    near = ranged.withColumn("_near", shift(row).over(
        Window.partitionBy(group, "_range").orderBy(*order)))
    outermost = F.struct(F.col(group).alias("group"), row.alias("row"))
    ends = ranged.groupBy("_range").agg((F.max if offset < 0 else F.min)(outermost).alias("_end"))
    across = ends.select("_range", shift("_end").over(Window.orderBy("_range")).alias("_across"))
    value = F.coalesce("_near", F.when(
        F.col("_across.group").eqNullSafe(F.col(group)), F.col("_across.row")))
    return near.join(F.broadcast(across), "_range").select(
        *ranged.columns, *[value[c].alias(prefix + c) for c in carry])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Spark limits each group before the shuffle when the rank is compared with a
    constant, so a hot group sends at most ``k`` rows per input task.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
                         ).filter(F.col(rank) <= k)


def until_empty(step: Callable[[int], bool]) -> int:
    """Run ``step(round)`` until it reports that nothing changed; the number of rounds."""
    return next(n for n in itertools.count(1) if not step(n))
