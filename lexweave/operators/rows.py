"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.storage import materialize


def each(df: DataFrame, keep: list, items: Column, position: str, item: str) -> DataFrame:
    """Explode an array with positions; rows without items vanish.

    The outer form with a filter behind it, because the optimizer guards a plain
    explode with a size filter in front, which computes ``items`` a second time.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(position, item)).where(
        F.col(position).isNotNull()
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when they arrive in fewer partitions than there are cores.

    Meant for work that is heavy per byte; inputs of many files pass unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, label: str, max_rows: int = 10_000) -> DataFrame:
    """A join side, written once and broadcast only if it is counted to be small."""
    written = materialize(df, label)
    return F.broadcast(written) if written.count() <= max_rows else written


def one_slice(df: DataFrame, key: str, slices: int, at: int) -> DataFrame:
    """The rows whose key is dealt to slice ``at`` of ``slices``."""
    return df if slices == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == at)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by key into the session's (initial) number of partitions.

    A stated number is not coalesced, which matters where a task's time depends
    on more than its bytes.  Grouping by the same keys needs no further shuffle.
    """
    conf = df.sparkSession.conf
    partitions = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return df.repartition(int(partitions or conf.get("spark.sql.shuffle.partitions")), *keys)
