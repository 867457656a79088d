"""Where derived tables and checkpoints live, and small session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the session.

    Only a local-mode session, where driver and executors are one process, may
    fall back to a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="lexweave-")
    return _own_dirs[context.applicationId]


def new_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, which also cuts lineage."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame | Iterable[DataFrame], label: str) -> tuple[DataFrame, str]:
    """``materialize`` for large tables, and the path to ``remove``: compressed harder, and the
    shuffle files behind it go at once instead of when the driver collects its garbage.

    Of several frames, each is written (and its shuffle files go) before the next.
    """
    frames = [df] if isinstance(df, DataFrame) else df
    path = None
    for frame in frames:
        spark = frame.sparkSession
        path = path or new_dir(spark, label)
        before = spark.conf.get(SHUFFLE_CLEANUP_SETTING, None)
        spark.conf.set(SHUFFLE_CLEANUP_SETTING, "true")
        try:
            frame.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                spark.conf.unset(SHUFFLE_CLEANUP_SETTING)
            else:
                spark.conf.set(SHUFFLE_CLEANUP_SETTING, before)
    return spark.read.schema(frame.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, through the file system Spark uses."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(
        hadoop_path, True
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df
