"""Table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.sources.tables import Target
from lexweave.storage import materialize, new_dir

# Incoming keys broadcast at most by an upsert.
MAX_BROADCAST_KEYS = 500_000


def create_tables(spark: SparkSession, target: Target, location: str | None = None) -> None:
    """Create the schema and its tables where absent."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {target.namespace}{where}")
    for name, schema in schemas.TABLES.items():
        spark.sql(
            schemas.create_table_ddl(target.table(name), schema, target.table_format)
        )


def overwrite_table(df: DataFrame, target: Target, name: str) -> int:
    """Replace a table, schema included; the count comes from what was written."""
    qualified = target.table(name)
    df.write.mode("overwrite").format(target.table_format).saveAsTable(qualified)
    return df.sparkSession.table(qualified).count()


def recreate_table(spark: SparkSession, target: Target, name: str) -> None:
    """Drop the table, present or not, and create it empty."""
    spark.sql(f"DROP TABLE IF EXISTS {target.table(name)}")
    spark.sql(
        schemas.create_table_ddl(
            target.table(name), schemas.TABLES[name], target.table_format
        )
    )


def last_rows(incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the last in ``order``, by partial aggregation."""
    rest = F.struct(*[c for c in incoming.columns if c != key])
    rows = incoming.groupBy(key).agg(F.max_by(rest, order).alias("_row"))
    return rows.select(key, "_row.*").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the incoming row if there is one, and of several the last
    in ``order``.

    ``existing`` has one row per key already, so it is only relieved of incoming
    keys and not shuffled while those are few.  The result is the whole index;
    ``versions`` rewrites only the files that hold an incoming key.
    """
    latest = materialize(
        last_rows(incoming, key, order).select(*existing.columns), "incoming"
    )
    keys = latest.select(key)
    if latest.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return existing.join(keys, key, "left_anti").select(*existing.columns).unionByName(latest)


def swap_table(df: DataFrame, target: Target, name: str) -> int:
    """Replace a table by a frame that may read it: the new rows go to a folder of
    their own, and only then does the table point there."""
    spark = df.sparkSession
    qualified = target.table(name)
    path = new_dir(spark, name)
    df.write.format(target.table_format).save(path)
    if spark.catalog.tableExists(qualified):
        spark.sql(f"ALTER TABLE {qualified} SET LOCATION '{path}'")
    else:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(
            f"CREATE TABLE {qualified} ({columns}) "
            f"USING {target.table_format} LOCATION '{path}'"
        )
    spark.catalog.refreshTable(qualified)
    return spark.table(qualified).count()


def run_log_rows(spark: SparkSession, entries: list[tuple[str, str, int, str]]) -> DataFrame:
    """Log rows (step, status, row count, message), one per step of a build."""
    return spark.createDataFrame(
        entries, "step_name string, status string, row_count bigint, message string"
    ).withColumn("logged_at", F.current_timestamp())


def append_run_log(
    spark: SparkSession, target: Target, entries: list[tuple[str, str, int, str]]
) -> None:
    run_log_rows(spark, entries).write.mode("append").insertInto(
        target.table("pipeline_run_log")
    )


def append_failures(failures: DataFrame, target: Target) -> None:
    """A log row for every file that could not be read (file_name, error)."""
    failures.select(
        F.lit("extract").alias("step_name"),
        F.lit("failed").alias("status"),
        F.lit(0).cast("bigint").alias("row_count"),
        F.concat_ws(": ", "file_name", "error").alias("message"),
        F.current_timestamp().alias("logged_at"),
    ).write.mode("append").insertInto(target.table("pipeline_run_log"))
