"""Ingest into a searchable index, retrieve, and ask."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.vectors import hash_embedding
from lexweave.operators import context
from lexweave.operators.documents import silver_chunks
from lexweave.operators.embed import Encoder, embed_chunks, embed_questions
from lexweave.operators.enrich import first_page_metadata, skip_known, with_metadata
from lexweave.operators.report import ingestion_summary
from lexweave.operators.search import (
    CHUNK_KEYS,
    DEFAULT_TOP_K,
    check_top_k,
    result_records,
    vector_search,
)
from lexweave.sinks.files import (
    append_registry,
    chunk_documents_json,
    write_chunk_json,
    write_document_text,
)
from lexweave.sinks.tables import swap_table, upsert
from lexweave.sources.files import PageExtractor, extract_pages, file_name, read_files
from lexweave.sources.tables import Target, chunk_documents, chunks_of_documents
from lexweave.storage import materialize, remove

MAX_TOP_K = 20

CHUNK_COLUMNS = (
    "chunk_uid",
    "document_id",
    "file_name",
    "chunk_id",
    "chunk_type",
    "article_number",
    "annex_number",
    "title",
    "chunk_text",
    "page_number",
    "part_index",
    "part_count",
    "char_length",
    "law_passed_date",
    "regulation_title",
    "document_version",
    "issuing_authority",
)


def ingest(pages: DataFrame) -> DataFrame:
    """Chunk rows of all documents, tagged with pages and document metadata."""
    chunks = with_metadata(silver_chunks(pages), first_page_metadata(pages))
    return chunks.select(*CHUNK_COLUMNS)


def registry_rows(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One registry row per ingested file."""
    file = ["document_id", "file_name"]
    counts = chunks.groupBy(*file).agg(F.count("*").alias("chunk_count"))
    return (
        first_page_metadata(pages)
        .join(counts, file, "left")
        .withColumnRenamed("file_name", "source_pdf")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .withColumn("ingested_at", F.current_timestamp())
    )


def split_ingest(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the documents that could be read, and the failures."""
    failed = F.col("error").isNotNull()
    return ingest(extracted.where(~failed).drop("error")), extracted.where(failed)


def retrieve(
    questions: DataFrame,
    embedded: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    encoder: Encoder = hash_embedding,
    **options,
) -> DataFrame:
    """Ranked chunks per question."""
    asked = embed_questions(questions, encoder)
    return vector_search(embedded, asked, top_k, **options)


def ask(
    questions: DataFrame,
    embedded: DataFrame,
    model: context.AnswerModel,
    top_k: int = DEFAULT_TOP_K,
    encoder: Encoder = hash_embedding,
) -> DataFrame:
    """Answer record per question with its ranked sources."""
    check_top_k(top_k, MAX_TOP_K)
    if not questions.where(F.coalesce(F.col("question") == "", F.lit(True))).isEmpty():
        raise ValueError("questions must not be empty")
    # Read twice below, and not to be searched again when an answer is retried.
    hits = materialize(retrieve(questions, embedded, top_k, encoder), "hits")
    prompts = context.rag_prompts(questions, context.build_context(hits))
    answers = context.generate_answers(prompts, model)
    record = F.struct("rank", "chunk_uid", "content", "metadata", "distance")
    listed = result_records(hits).groupBy("query_id").agg(
        F.array_sort(F.collect_list(record)).alias("retrieved_chunks")
    )
    return answers.join(listed, "query_id", "left")


def ask_with_sources(
    questions: DataFrame,
    embedded: DataFrame,
    model: context.AnswerModel,
    top_k: int = DEFAULT_TOP_K,
    encoder: Encoder = hash_embedding,
) -> DataFrame:
    """Answer record over numbered source blocks: the sources as shown, previews only, and
    the retrieved chunks in full.  A question without results gets the fixed answer and
    empty lists."""
    check_top_k(top_k, MAX_TOP_K)
    hits = materialize(retrieve(questions, embedded, top_k, encoder), "hits")
    prompts = context.rag_prompts(questions, context.source_context(hits))
    shown = context.sources(hits)
    listed = {
        "sources": (shown, [c for c in shown.columns if c != "query_id"]),
        "retrieved_chunks": (
            hits,
            ["rank", *[c for c in hits.columns if c not in ("rank", "query_id")]],
        ),
    }
    records = context.generate_answers(prompts, model)
    for name, (rows, columns) in listed.items():
        lists = rows.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct(*columns))).alias(name)
        )
        records = records.join(lists, "query_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(lists.schema[name].dataType))
        )
    return records


@dataclass(frozen=True)
class Store:
    """Where ingested documents go: an index table, chunk JSON and a registry."""

    target: Target
    json_dir: str
    registry_dir: str
    index: str = "chunk_index"


def ingest_into(
    extracted: DataFrame, store: Store, encoder: Encoder = hash_embedding, recreate: bool = False
) -> DataFrame:
    """Ingest all documents at once and return the failures.

    Chunks are written as JSON, embedded and upserted into the index; every
    document that could be read gets a registry row.  ``recreate`` starts index, JSON and
    registry anew.  The three are written one after the other; ``plans.library`` makes them
    visible together.
    """
    return _ingest_into(extracted, store, encoder, recreate)[2]


def _ingest_into(
    extracted: DataFrame, store: Store, encoder: Encoder, recreate: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``ingest_into``; the pages, the chunks and the failures."""
    spark = extracted.sparkSession
    extracted = materialize(extracted, "extracted")
    failed = F.col("error").isNotNull()
    pages = extracted.where(~failed).drop("error")
    chunks = materialize(ingest(pages), "chunks")

    headers = registry_rows(pages, chunks)
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {store.target.table(store.index)}")
        for folder in (store.json_dir, store.registry_dir):
            remove(spark, folder)
    write_chunk_json(chunk_documents_json(chunks, headers), f"{store.json_dir}/{uuid4().hex}")

    index_chunks(chunks, store, encoder)

    append_registry(headers, store.registry_dir)
    return pages, chunks, extracted.where(failed)


def ingest_directory(
    spark: SparkSession,
    directory: str,
    store: Store,
    extractor: PageExtractor,
    method: str,
    text_dir: str,
    encoder: Encoder = hash_embedding,
    recreate: bool = False,
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ingest the PDF files of a directory, but for those that ``known`` registry rows name.

    Their text is written under ``text_dir``, a folder for each run.  Returns a summary row
    per document and the files that could not be read.
    """
    files = read_files(spark, directory)
    if known is not None:
        named = files.withColumn("source_pdf", file_name(F.col("path")))
        files = skip_known(named, known, "source_pdf").drop("source_pdf")
    pages, chunks, failures = _ingest_into(
        extract_pages(files, extractor, method), store, encoder, recreate
    )
    write_document_text(pages, f"{text_dir}/{uuid4().hex}")
    return ingestion_summary(chunks, pages), failures


def index_chunks(
    chunks: DataFrame,
    store: Store,
    encoder: Encoder = hash_embedding,
    order: Column | None = None,
) -> int:
    """Embed chunk rows and upsert them into the index; the number of rows it then has.

    Of the rows of a label the last in ``order`` wins, by default that of the last chunk.
    """
    spark, name = chunks.sparkSession, store.target.table(store.index)
    incoming = embed_chunks(chunks, encoder).drop("embedding_model", "embedding_version")
    if spark.catalog.tableExists(name):
        existing = spark.table(name)
    else:
        existing = incoming.drop("ingested_at").limit(0)
    last = F.col("chunk_id") if order is None else order
    merged = upsert(existing, incoming, CHUNK_KEYS[0], last)
    return swap_table(merged, store.target, store.index)


def reindex(spark: SparkSession, store: Store, encoder: Encoder = hash_embedding) -> int:
    """Index the chunk JSON of a store anew, without reading any document again.

    Of a document that several runs have written, the last run counts.
    """
    documents = chunk_documents(spark, f"{store.json_dir}/*")
    last = documents.groupBy("document_id", "source_pdf").agg(
        F.max("ingested_at").alias("ingested_at")
    )
    same = [
        F.col(f"d.{c}").eqNullSafe(F.col(f"l.{c}"))
        for c in ("document_id", "source_pdf", "ingested_at")
    ]
    latest = documents.alias("d").join(last.alias("l"), same, "left_semi")
    chunks = chunks_of_documents(latest, "source_pdf", "ingested_at").withColumnRenamed(
        "source_pdf", "file_name"
    )
    return index_chunks(chunks, store, encoder, F.struct("ingested_at", "chunk_id"))
