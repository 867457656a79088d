"""Exact deduplication by content sort.

The normalised texts are range-partitioned at sampled splitters and sorted, so that
equal texts are neighbours; each text is compared in full with the one before it.  The
sort key is (first characters, SHA-256, text, id): the splitters, which the driver
sees, stay small however long the texts are, and a group of copies of any size is cut
by id over as many partitions as it needs.  What a partition cannot decide alone are
its first and last run of equal texts; these, at most two per partition, are compared
once more across partitions.

A null text counts as empty.  Of equal texts the row with the smallest id stays (null
ids last); among rows that repeat an id and its text exactly one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.llm.tables import SPACE, partitions
from lexweave.storage import materialize

PREFIX_CHARS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, carried: bool):
    """Rows in order with the number of their run, then one row for each run to sum up.

    A run is summed up if it holds several rows or touches an end of the partition; in
    the latter case with its text.
    """
    run, size, keep, text = -1, 0, None, None

    def rows(doc_id, sha, number, first, row):
        n = len(number)
        columns = [
            pa.array(number, pa.int64()), doc_id, sha, pa.array(first, pa.bool_()),
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns + ([row] if carried else []), schema=schema)

    def summary(number, size, keep, text):
        columns = [
            pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()),
            pa.nulls(1, pa.bool_()), pa.array([size], pa.int64()),
            pa.array([keep], pa.int64()), pa.array([text], pa.string()),
        ]
        carry = [pa.nulls(1, schema.field("row").type)] if carried else []
        return pa.RecordBatch.from_arrays(columns + carry, schema=schema)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts, doc_id = batch.column("text"), batch.column("doc_id")
        same = pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        starts = [not (run >= 0 and texts[0].as_py() == text), *(~same).tolist()]
        number = []
        for i, new in enumerate(starts):
            if new:
                if run >= 0 and (size > 1 or run == 0):
                    yield summary(run, size, keep, text if run == 0 else None)
                run, size, keep = run + 1, 0, doc_id[i].as_py()
                if run == 0:
                    text = texts[i].as_py()
            size += 1
            number.append(run)
        text = texts[len(texts) - 1].as_py()
        yield rows(
            doc_id, batch.column("text_sha256"), number, starts,
            batch.column("row") if carried else None,
        )
    if run >= 0:
        yield summary(run, size, keep, text)


def content_sort(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): every row with its run of equal texts, and the runs of several rows.

    ``rows`` has part, run, doc_id, text_sha256, first and, with ``carry``, the whole
    input row as ``row``.  ``runs`` has part, run, keep_id, group_size and owns, which
    says whether the row that stays is in this part.
    """
    spark = df.sparkSession
    keyed = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(F.col(text_col)).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    )
    keyed = keyed.withColumn("text_sha256", F.sha2(F.col("text"), 256)).withColumn(
        "head", F.substring("text", 1, PREFIX_CHARS)
    )
    order = [F.col("head"), F.col("text_sha256"), F.col("doc_id").asc_nulls_last()]
    dealt = (
        keyed.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order[:2], "text", order[2])
        .drop("head")
    )
    kinds = [
        T.StructField("run", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("first", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("edge_text", T.StringType()),
    ]
    if carry:
        kinds.append(T.StructField("row", keyed.schema["row"].dataType))
    arrow = to_arrow_schema(T.StructType(kinds))
    runs_of = _runs

    def scan(batches):
        return runs_of(batches, arrow, carry)

    found = materialize(
        dealt.mapInArrow(scan, T.StructType(kinds)).withColumn("part", F.spark_partition_id()),
        "content-sort",
    )
    rows = found.where("size is null").drop("size", "keep_id", "edge_text")
    summed = found.where("size is not null").select("part", "run", "size", "keep_id", "edge_text")
    inner = summed.where("edge_text is null").select(
        "part", "run", "keep_id", F.col("size").alias("group_size"), F.lit(True).alias("owns")
    )
    alike = Window.partitionBy("edge_text")
    edges = summed.where("edge_text is not null").select(
        "part",
        "run",
        F.min("keep_id").over(alike).alias("keep_id"),
        F.sum("size").over(alike).alias("group_size"),
        (F.col("part") == F.min("part").over(alike)).alias("owns"),
    )
    return rows, inner.unionByName(edges)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows, runs = content_sort(df, id_col, text_col)
    return rows.join(runs, ["part", "run"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id"))
        .otherwise(F.col("keep_id"))
        .alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first") & F.coalesce("owns", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    rows, runs = content_sort(df, id_col, text_col, carry=True)
    # Only a run that another partition began loses its first row: one per partition.
    lost = F.broadcast(runs.where(~F.col("owns")).select("part", "run"))
    return rows.where("first").join(lost, ["part", "run"], "left_anti").select("row.*")
