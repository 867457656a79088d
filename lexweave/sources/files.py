"""Document files and their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import non_empty
from lexweave.operators.enrich import REGULATION_FAMILIES, lookup
from lexweave.operators.rows import each
from lexweave.storage import require_rows

# Fixed values of a document row.
SOURCE_NAME = "EUR-Lex"
FILE_TYPE = "pdf"
NEW_STATUS = "new"
URL_PREFIX = "https://eur-lex.europa.eu/legal-content/EN/TXT/PDF/?uri=CELEX:"

# Takes the bytes of one file, returns its page texts.
PageExtractor = Callable[[bytes], list[str]]

_EXTRACTED = (
    "document_id string, file_name string, page_number int, page_text string, error string"
)


def read_files(spark: SparkSession, directory: str, glob: str = "*.pdf") -> DataFrame:
    """Files of a directory as (path, content); unread columns are not loaded."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(directory)
        .select("path", "content")
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")


def document_rows(files: DataFrame, volume_dir: str) -> DataFrame:
    """One row per file of a frame with a ``file_name`` column, not yet stamped."""
    return files.select(
        stem(F.col("file_name")).alias("document_id"),
        F.col("file_name"),
        F.concat(F.lit(f"{volume_dir}/"), F.col("file_name")).alias("source_path"),
        F.lit(SOURCE_NAME).alias("source_name"),
        lookup(stem(F.col("file_name")), REGULATION_FAMILIES).alias("regulation_family"),
        F.lit(FILE_TYPE).alias("file_type"),
        F.lit(NEW_STATUS).alias("status"),
    )


def bronze_documents(spark: SparkSession, directory: str, volume_dir: str) -> DataFrame:
    files = read_files(spark, directory).select(file_name(F.col("path")).alias("file_name"))
    return document_rows(require_rows(files, f"no PDF files in {directory}"), volume_dir)


def extract_pages(files: DataFrame, extractor: PageExtractor, method: str) -> DataFrame:
    """Pages of every file; a file the extractor fails on gives one row with the
    error and no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for document_id, name, content in zip(
                frame["document_id"], frame["file_name"], frame["content"]
            ):
                try:
                    texts, error = extractor(bytes(content)), None
                except Exception as failure:  # noqa: BLE001 - one bad file must not end the job
                    texts, error = [None], f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame(
                    {
                        "document_id": document_id,
                        "file_name": name,
                        "page_number": range(1, len(texts) + 1),
                        "page_text": texts,
                        "error": error,
                    }
                )

    named = files.select(
        stem(file_name(F.col("path"))).alias("document_id"),
        file_name(F.col("path")).alias("file_name"),
        "content",
    )
    return with_page_facts(named.mapInPandas(run, _EXTRACTED), method)


def text_pages(documents: DataFrame, method: str = "text") -> DataFrame:
    """Pages of text documents, whose pages are separated by form feeds."""
    return with_page_facts(
        each(
            documents,
            ["document_id", "file_name"],
            F.split("full_text", "\f"),
            "position",
            "page_text",
        ).select(
            "document_id",
            "file_name",
            (F.col("position") + 1).alias("page_number"),
            "page_text",
        ),
        method,
    )


def with_page_facts(pages: DataFrame, method: str) -> DataFrame:
    return pages.withColumns(
        {
            "char_count": F.length("page_text"),
            "extraction_method": F.lit(method),
        }
    )


def source_manifest(documents: DataFrame) -> DataFrame:
    """Title, URL, CELEX number and language of documents named ``<celex>_<lang>``."""
    title = F.col("document_id")
    celex = F.substring_index(title, "_", 1)
    return documents.select(
        title.alias("title"),
        F.concat(F.lit(URL_PREFIX), celex).alias("url"),
        celex.alias("celex_id"),
        non_empty(F.substring_index(title, "_", -1)).alias("language"),
    )
