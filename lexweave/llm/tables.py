"""Small helpers the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space is these bytes and nothing else (fixed value of the contracts).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARK_BATCH = "67108864b"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python ``BATCH_BYTES`` at a time, unless the session names a size.

    Spark's own bounds are 10,000 rows and 64 MB, which whole texts fill in every task, outside
    the heap and once more in its Python worker.
    """
    if spark.conf.get(BATCH_SETTING) == SPARK_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def passing(
    df: DataFrame, keep: list[str] | None, added: list[T.StructField], read: list[str]
) -> tuple[DataFrame, list[str], T.StructType]:
    """For a function over Arrow batches that adds fields to rows: the rows with the columns
    it needs, the names that pass through, and the schema of the result.

    A column named as an added field gives way; ``keep`` names the others to return.
    """
    new = [f.name for f in added]
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in names] + added)
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, *read])]), names, schema


def record(
    batch: pa.RecordBatch, names: list[str], new: list[pa.Array], schema: pa.Schema
) -> pa.RecordBatch:
    """The named columns of a batch with new ones behind them."""
    arrays = [batch.column(c) for c in names] + new
    return pa.RecordBatch.from_arrays(
        [x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema
    )
