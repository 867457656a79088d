"""Counts and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import preview


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def ingestion_summary(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: chunks, chunks without a page, characters and pages."""
    by_chunk = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("page_number").isNull()).alias("skipped"),
    )
    by_page = pages.groupBy("document_id").agg(
        (F.sum(F.length("page_text")) + F.count("*") - 1).alias("chars"),
        F.count("*").alias("pages"),
    )
    return by_page.join(by_chunk, "document_id", "left").select(
        "document_id",
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("skipped", F.lit(0)).alias("skipped"),
        "chars",
        "pages",
    )


def search_summary(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Hits and best score per query, also for queries without hits."""
    found = results.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.max("score").alias("top_score")
    )
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("hits", F.lit(0)).alias("hits"), "top_score"
    )


def facet_counts(chunks: DataFrame, facets: list[str]) -> DataFrame:
    """Value counts of several columns in one pass."""
    return (
        chunks.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))
            for f in facets
        ])).alias("f"))
        .groupBy("f.facet", "f.value")
        .agg(F.count("*").alias("row_count"))
    )


def index_stats(embedded: DataFrame, key: str = "chunk_uid", cut: int = 100) -> DataFrame:
    """Row count, field names and one sample row without its vector, in one pass."""
    fields = [c for c in embedded.columns if c != "embedding"]
    sample = F.struct(*[preview(F.col(c).cast("string"), cut).alias(c) for c in fields])
    order = F.struct(key, "chunk_id") if "chunk_id" in fields else F.col(key)
    return embedded.agg(
        F.count("*").alias("row_count"), F.min_by(sample, order).alias("sample")
    ).select(
        "row_count",
        F.lit(",".join(embedded.columns)).alias("field_names"),
        *[F.col(f"sample.{c}").alias(f"sample_{c}") for c in fields],
    )
