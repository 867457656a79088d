"""Constant lookups and the join of chunks with their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import document_metadata

# What is known about documents besides their text.
REGULATION_FAMILIES = {
    "32014L0065_EN": "MiFID II",
    "32015L2366_EN": "PSD2",
    "32016R0679_EN": "GDPR",
    "32024L1640_EN": "AMLD",
    "32024R1689_EN": "AI Act",
}
LAW_PASSED_DATES = {
    "32014L0065_EN": "2014-05-15",
    "32015L2366_EN": "2015-11-25",
    "32016R0679_EN": "2016-04-27",
    "32024L1640_EN": "2024-05-31",
    "32024R1689_EN": "2024-06-13",
}

_GOLD_FROM_CHUNKS = (
    "chunk_uid",
    "document_id",
    "file_name",
    "chunk_id",
    "page_number",
    "chunk_type",
    "article_number",
    "annex_number",
    "title",
    "part_index",
    "part_count",
    "chunk_text",
    "char_length",
    "law_passed_date",
    "ingested_at",
)
_GOLD_FROM_DOCUMENTS = ("source_path", "source_name", "regulation_family")


def lookup(key: Column, values: dict[str, str]) -> Column:
    """Constant lookup, null on a miss; a literal map, so no join."""
    entries = [F.lit(part) for pair in values.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def gold_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Every chunk with the source fields of its document, if that is known."""
    right = documents.select("document_id", *_GOLD_FROM_DOCUMENTS)
    kept = [c for c in _GOLD_FROM_CHUNKS if c in chunks.columns]
    return chunks.join(right, "document_id", "left").select(*kept, *_GOLD_FROM_DOCUMENTS)


def first_page_metadata(pages: DataFrame) -> DataFrame:
    """Metadata of every file, read off its first page in order, whatever its number."""
    first = F.min(F.struct("page_number", F.coalesce("page_text", F.lit("")).alias("text")))
    return (
        pages.groupBy("document_id", "file_name")
        .agg(first.alias("page"))
        .select("document_id", "file_name", document_metadata(F.col("page.text")).alias("meta"))
        .select("document_id", "file_name", "meta.*")
    )


def with_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunk rows carrying the metadata of their file."""
    return chunks.drop("law_passed_date").join(metadata, ["document_id", "file_name"], "left")


def skip_known(candidates: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Candidates not yet in the registry."""
    return candidates.join(registry.select(key), key, "left_anti")


def known(candidates: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return candidates.join(registry.select(key), key, "left_semi")
