"""Bronze, silver and gold tables, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions.vectors import HASH_MODEL, HASH_VERSION, hash_embedding
from lexweave.operators.documents import silver_chunks
from lexweave.operators.embed import Encoder, embed_chunks
from lexweave.operators.enrich import gold_chunks
from lexweave.operators.report import table_counts
from lexweave.sinks.tables import (
    append_failures,
    append_run_log,
    create_tables,
    overwrite_table,
)
from lexweave.sources.files import PageExtractor, bronze_documents, extract_pages, read_files
from lexweave.sources.tables import Target
from lexweave.storage import materialize, require_rows

LAYERS = (
    "bronze_raw_documents",
    "silver_extracted_pages",
    "silver_chunks",
    "gold_ai_ready_chunks",
    "gold_embedded_chunks",
)


def _write(df: DataFrame, target: Target, name: str, stamp: str | None) -> int:
    if stamp:
        df = df.withColumn(stamp, F.current_timestamp())
    return overwrite_table(schemas.conform(df, schemas.TABLES[name], strict=True), target, name)


def write_bronze(documents: DataFrame, target: Target) -> int:
    return _write(documents, target, "bronze_raw_documents", "ingestion_timestamp")


def write_pages(pages: DataFrame, target: Target) -> int:
    return _write(pages, target, "silver_extracted_pages", "extracted_at")


def write_chunks(spark: SparkSession, target: Target) -> int:
    pages = require_rows(
        spark.table(target.table("silver_extracted_pages")), "no extracted pages to chunk"
    )
    chunks = silver_chunks(pages).withColumn("ingested_at", F.current_timestamp())
    return _write(chunks, target, "silver_chunks", "created_at")


def write_gold(spark: SparkSession, target: Target) -> int:
    gold = gold_chunks(
        spark.table(target.table("silver_chunks")),
        spark.table(target.table("bronze_raw_documents")),
    )
    return _write(gold, target, "gold_ai_ready_chunks", "gold_created_at")


def write_embeddings(
    spark: SparkSession,
    target: Target,
    encoder: Encoder = hash_embedding,
    model: str = HASH_MODEL,
    version: str = HASH_VERSION,
) -> int:
    gold = require_rows(
        spark.table(target.table("gold_ai_ready_chunks")), "gold_ai_ready_chunks is empty"
    )
    embedded = embed_chunks(gold, encoder, model, version)
    return _write(embedded, target, "gold_embedded_chunks", "embedded_at")


def build(
    spark: SparkSession,
    target: Target,
    documents: DataFrame,
    pages: DataFrame,
    *,
    location: str | None = None,
    encoder: Encoder = hash_embedding,
) -> DataFrame:
    """Build all layers, log every step, and return the table counts."""
    create_tables(spark, target, location)
    steps = {
        "bronze": lambda: write_bronze(documents, target),
        "pages": lambda: write_pages(pages, target),
        "chunks": lambda: write_chunks(spark, target),
        "gold": lambda: write_gold(spark, target),
        "embeddings": lambda: write_embeddings(spark, target, encoder),
    }
    log = []
    try:
        for name, step in steps.items():
            try:
                log.append((name, "ok", step(), ""))
            except Exception as failure:
                log.append((name, "failed", 0, str(failure)))
                raise
    finally:
        append_run_log(spark, target, log)
    return table_counts({name: spark.table(target.table(name)) for name in LAYERS})


def build_from_directory(
    spark: SparkSession,
    target: Target,
    directory: str,
    extractor: PageExtractor,
    method: str,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The same for the PDF files of a directory; also returns the files that could not be
    read, each of which has a row in the run log."""
    pages = materialize(
        extract_pages(read_files(spark, directory), extractor, method), "extracted"
    )
    documents = bronze_documents(spark, directory, target.raw_root)
    good, failures = (pages.where(F.col("error").isNull()), pages.where(F.col("error").isNotNull()))
    counts = build(spark, target, documents, good.drop("error"), **options)
    append_failures(failures, target)
    return counts, failures
