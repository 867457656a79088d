"""File sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas

# A chunk document holds at most this many chunks; a longer document continues in
# further ones, numbered by ``piece``, so that no row grows with the largest document.
CHUNKS_PER_JSON = 10_000

_HEADER_FIELDS = (
    "source_pdf",
    "regulation_title",
    "document_version",
    "issuing_authority",
    "law_passed_date",
)


def chunk_documents_json(
    chunks: DataFrame, headers: DataFrame, fallback_date: Column | None = None
) -> DataFrame:
    """Nested chunk documents: header fields, chunk count and the chunks in order.

    ``headers`` has one row per document, or per file where chunks have a file name; its
    law date wins over the fallback.  ``chunk_count`` counts the chunks of all pieces.
    """
    by_file = "file_name" in chunks.columns
    document = ["document_id", "source_pdf"] if by_file else ["document_id"]
    chunks = chunks.withColumnRenamed("file_name", "source_pdf")
    counts = chunks.groupBy(*document).agg(
        F.count("*").cast("int").alias("chunk_count")
    )
    nested = chunks.groupBy(
        *document, F.expr(f"chunk_id div {CHUNKS_PER_JSON}").cast("int").alias("piece")
    ).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "chunk_id",
                    "chunk_uid",
                    F.col("chunk_type").alias("type"),
                    "article_number",
                    "annex_number",
                    "title",
                    "part_index",
                    "part_count",
                    F.col("page_number").alias("page"),
                    F.col("chunk_text").alias("text"),
                    F.length("chunk_text").alias("char_length"),
                )
            )
        ).alias("chunks")
    )
    law_date = F.col("law_passed_date")
    if fallback_date is not None:
        law_date = F.coalesce(law_date, fallback_date)
    return (
        nested.join(headers.select("document_id", *_HEADER_FIELDS), document, "left")
        .join(counts, document)
        .select(
            "document_id",
            "source_pdf",
            "regulation_title",
            "document_version",
            "issuing_authority",
            law_date.alias("law_passed_date"),
            F.current_timestamp().alias("ingested_at"),
            "chunk_count",
            "piece",
            "chunks",
        )
    )


def write_chunk_json(documents: DataFrame, path: str) -> None:
    """One JSON document per line, null fields and non-ASCII text kept."""
    documents.write.option("ignoreNullFields", False).json(path)


def write_document_text(pages: DataFrame, path: str) -> None:
    """Page texts as JSON lines sorted by document and page.

    Pages are range-partitioned, so the number of files follows the amount of text: small
    documents share a file and a long one spreads over several.  Each line has its page
    number, which gives the order of the pages whatever the files are called.
    """
    order = ["document_id", F.col("page_number").asc_nulls_first(), "page_text"]
    (
        pages.select(
            "document_id", "page_number", F.coalesce("page_text", F.lit("")).alias("page_text")
        )
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .write.option("ignoreNullFields", False)
        .json(path)
    )


def read_document_text(spark: SparkSession, path: str) -> DataFrame:
    """Full text per document as written by ``write_document_text``: its pages in order,
    joined by newlines."""
    pages = spark.read.schema("document_id string, page_number int, page_text string").json(path)
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "page_text")))
    return pages.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["page_text"]), "\n").alias("full_text")
    )


def write_embeddings_json(embedded: DataFrame, path: str) -> None:
    embedded.write.json(path)


def write_eval_csv(results: DataFrame, path: str) -> bool:
    """Scores as CSV with a header; nothing is written when there are none."""
    if results.isEmpty():
        return False
    (
        results.select(*schemas.EVAL_COLUMNS)
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return True


def append_registry(rows: DataFrame, path: str) -> None:
    schemas.conform(rows, schemas.REGISTRY, strict=True).write.mode("append").parquet(path)
