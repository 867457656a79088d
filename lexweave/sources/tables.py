"""Tables and JSON documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas


@dataclass(frozen=True)
class Target:
    """The namespace of a build's tables, their format, and the root under which its raw
    files are listed."""

    namespace: str
    table_format: str = "parquet"
    raw_root: str = "raw"

    def table(self, name: str) -> str:
        return f"{self.namespace}.{name}"


def table_scan(spark: SparkSession, target: Target, name: str) -> DataFrame:
    return spark.table(target.table(name))


def chunk_json_source(
    spark: SparkSession, path: str, *, multi_line: bool = False
) -> DataFrame:
    """Chunk rows of nested chunk documents, document fields carried down.

    ``char_length`` is counted anew and the source file is the stored one's name.
    """
    return chunks_of_documents(chunk_documents(spark, path, multi_line=multi_line))


def chunk_documents(
    spark: SparkSession, path: str, *, multi_line: bool = False
) -> DataFrame:
    """Nested chunk documents as they were written."""
    reader = spark.read.schema(schemas.CHUNK_DOCUMENT)
    return reader.option("multiLine", multi_line).json(path)


def chunks_of_documents(documents: DataFrame, *extra: str) -> DataFrame:
    """Chunk rows of nested chunk documents; ``extra`` names further document fields."""
    return documents.select(
        *extra,
        "document_id",
        "law_passed_date",
        "regulation_title",
        "document_version",
        "issuing_authority",
        F.explode("chunks").alias("chunk"),
    ).select(
        *extra,
        "document_id",
        F.col("chunk.chunk_uid"),
        F.col("chunk.chunk_id"),
        F.col("chunk.type").alias("chunk_type"),
        F.col("chunk.article_number"),
        F.col("chunk.annex_number"),
        F.col("chunk.title"),
        F.coalesce("chunk.part_index", F.lit(0)).alias("part_index"),
        F.coalesce("chunk.part_count", F.lit(1)).alias("part_count"),
        F.col("chunk.page").alias("page_number"),
        F.col("chunk.text").alias("chunk_text"),
        F.length("chunk.text").alias("char_length"),
        "law_passed_date",
        "regulation_title",
        "document_version",
        "issuing_authority",
    )


def golden_dataset(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schemas.GOLDEN).option("multiLine", multi_line).json(path)


def registry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Ingested documents; JSON registries may be one array over many lines."""
    reader = spark.read.schema(schemas.REGISTRY).format(fmt)
    return (reader.option("multiLine", True) if fmt == "json" else reader).load(path)
