"""From page rows to chunk rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import chunking
from lexweave.functions.chunking import PAGE_TIERS, let
from lexweave.functions.text import match_form
from lexweave.operators.enrich import LAW_PASSED_DATES, lookup
from lexweave.operators.long_documents import (
    first_ids,
    long_units,
    numbered_chunks,
    placed_pages,
    with_cuts,
)
from lexweave.operators.page_search import found_pages
from lexweave.operators.rows import by_key, each, one_slice, small_side
from lexweave.storage import remove, scratch

# A document of up to this many characters is put together in one row, where the
# search for its chunks' pages grows with chunks times pages.  Longer documents
# stay spread out over their pages, see ``long_documents`` and ``_tag_long``.
IN_ROW_CHARS = 2_000_000

# Pages of a long document that are searched together: so many early ones, then as
# many again.
EARLY_PAGES = 16_384

# Long documents of more characters than this in all are handled in up to so many slices,
# one after the other, as the shuffle files of a slice go before the next.
SLICE_CHARS = 1 << 25
SLICES = 4

_DOCUMENT = ("document_id", "file_name")

# Parts of the key that stands for a file among the pages of long documents.
_BETWEEN, _MISSING = "\x00", "\x01"


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts of a document in page order, joined by newlines."""
    return _assembled(pages).select(
        *_DOCUMENT, F.array_join("page_texts", "\n").alias("full_text")
    )


def _assembled(pages: DataFrame, *partition_by: str) -> DataFrame:
    """Page texts in order per document, partitioned by document id by default, as
    the joins on document id that follow need it."""
    in_order = F.array_sort(
        F.collect_list(
            F.struct("page_number", F.coalesce("page_text", F.lit("")).alias("page_text"))
        )
    )
    keys = partition_by or ("document_id",)
    return by_key(pages, *keys).groupBy(*_DOCUMENT).agg(
        F.transform(in_order, lambda p: p["page_text"]).alias("page_texts")
    )


def _mark(chunk: Column) -> Column:
    return chunking.fingerprint(
        chunk["chunk_text"],
        chunk["chunk_type"],
        chunk["article_number"],
        chunk["annex_number"],
        chunk["part_index"],
    )


def _chunk_rows(numbered: DataFrame, document_id: Column | None = None) -> DataFrame:
    """Flat chunk rows of (document, ``chunk_id``, chunk struct ``c``) rows."""
    return numbered.select(
        chunking.chunk_uid(
            F.col("document_id") if document_id is None else document_id,
            F.col("c.chunk_type"),
            F.col("c.article_number"),
            F.col("c.annex_number"),
            F.col("c.part_index"),
            F.col("chunk_id"),
        ).alias("chunk_uid"),
        *_DOCUMENT,
        "chunk_id",
        "c.*",
        F.length("c.chunk_text").alias("char_length"),
    )


def _numbered(documents: DataFrame, chunks: Column) -> DataFrame:
    return each(documents, [*_DOCUMENT], chunks, "chunk_id", "c")


def chunk_documents(documents: DataFrame, text: str = "full_text") -> DataFrame:
    """Numbered chunk rows of documents, without page numbers and without a shuffle."""
    return _chunk_rows(_numbered(documents, chunking.chunk_array(F.col(text))))


def split_by_length(
    pages: DataFrame, in_row_chars: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Pages of documents that fit in a row, and of those that do not, each if any.

    The check reads document ids and text lengths only.
    """
    length = F.col("char_count") if "char_count" in pages.columns else F.length("page_text")
    is_long = (F.col("chars") > in_row_chars) & F.col("document_id").isNotNull()
    # The ids of long documents, and null for all others.
    ids, _ = scratch(
        pages.groupBy("document_id")
        .agg(F.sum(length + 1).alias("chars"))
        .select(F.when(is_long, F.col("document_id")).alias("document_id"))
        .distinct(),
        "long-documents",
    )
    long = ids.where(F.col("document_id").isNotNull())
    if long.isEmpty():
        return pages, None
    if ids.where(F.col("document_id").isNull()).isEmpty():
        return None, pages
    long = small_side(long, "long-documents")
    return (
        pages.join(long, "document_id", "left_anti"),
        pages.join(long, "document_id", "left_semi"),
    )


def _file_key() -> Column:
    parts = [F.coalesce(name, F.lit(_MISSING)) for name in _DOCUMENT]
    return F.concat(parts[0], F.lit(_BETWEEN), parts[1])


def _id_of_key() -> Column:
    return F.nullif(F.substring_index("document_id", _BETWEEN, 1), F.lit(_MISSING))


def _by_file(pages: DataFrame) -> DataFrame:
    """Pages of long documents as the blocks need them: one key for each file, and a
    page's number is its position, as it is where a document is put together in a row."""
    return _in_order(pages.withColumn("document_id", _file_key()))


def _in_order(pages: DataFrame) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(
        F.asc_nulls_first("page_number"), F.coalesce("page_text", F.lit(""))
    )
    return pages.withColumn("page_number", F.row_number().over(order))


def tag_pages(
    chunks: DataFrame, pages: DataFrame, in_row_chars: int = IN_ROW_CHARS
) -> DataFrame:
    """Page number per chunk: the first page that contains the 200-character prefix
    of its fingerprint, else the 100-, else the 50-character one."""
    short, long = split_by_length(pages, in_row_chars)
    if long is None:
        return _tag_short(chunks, _page_forms(short))
    ids = long.select("document_id").distinct()
    of_long = chunks.join(ids, "document_id", "left_semi").withColumn("document_id", _file_key())
    tagged = _tag_long(of_long, _by_file(long)).withColumn("document_id", _id_of_key())
    # Chunks of documents without pages are among those of short ones.
    rest = chunks.join(ids, "document_id", "left_anti")
    return _tag_short(rest, _page_forms(pages.limit(0) if short is None else short)).unionByName(tagged)


def _page_forms(pages: DataFrame) -> DataFrame:
    return _assembled(pages, *_DOCUMENT).select(
        *_DOCUMENT, F.transform("page_texts", match_form).alias("page_forms")
    )


def _tag_short(chunks: DataFrame, forms: DataFrame) -> DataFrame:
    mark = chunking.fingerprint(
        F.col("chunk_text"),
        F.col("chunk_type"),
        F.col("article_number"),
        F.col("annex_number"),
        F.col("part_index"),
    )
    page = let(mark, lambda m: chunking.locate_page(m, F.col("page_forms")))
    return (
        by_key(chunks, *_DOCUMENT)
        .join(forms, [*_DOCUMENT], "left")
        .withColumn("page_number", page)
        .select(*chunks.columns, "page_number")
    )


def _tag_long(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``tag_pages`` for documents of any length, see ``page_search``."""
    mark = chunking.fingerprint(
        F.col("chunk_text"),
        F.col("chunk_type"),
        F.col("article_number"),
        F.col("annex_number"),
        F.col("part_index"),
    )
    marks = chunks.select(
        "document_id", F.struct("chunk_id").alias("key"), let(mark, _beginning).alias("mark")
    )
    located = found_pages(marks, pages, EARLY_PAGES).select(
        "document_id", "key.chunk_id", "page_number"
    )
    return chunks.join(located, ["document_id", "chunk_id"], "left").select(
        *chunks.columns, "page_number"
    )


def _beginning(mark: Column) -> Column:
    return F.substring(mark, 1, PAGE_TIERS[0])


def silver_chunks(pages: DataFrame, in_row_chars: int = IN_ROW_CHARS) -> DataFrame:
    """Chunk rows with page numbers and law dates, from page rows.

    One shuffle brings a document's pages together; chunking and the page search
    happen in that row.  Documents too long for that are handled in blocks.
    """
    short, long = split_by_length(pages, in_row_chars)
    parts = [chunks_of(rows) for chunks_of, rows in ((_short_chunks, short), (_long_chunks, long)) if rows is not None]
    return _finished(reduce(DataFrame.unionByName, parts))


def _short_chunks(pages: DataFrame) -> DataFrame:
    chunked = _assembled(pages).select(
        *_DOCUMENT,
        chunking.chunk_array(F.array_join("page_texts", "\n")).alias("chunks"),
        F.transform("page_texts", match_form).alias("page_forms"),
    )
    located = F.transform(
        "chunks",
        lambda c: c.withField(
            "page_number",
            let(_mark(c), lambda m: chunking.locate_page(m, F.col("page_forms"))),
        ),
    )
    return _chunk_rows(_numbered(chunked, located))


def _long_chunks(pages: DataFrame) -> DataFrame:
    """Texts are written as pages and as units of chunks.  Numbers of chunks and of their
    pages are found apart from them and joined at the end."""
    spark = pages.sparkSession
    written, unplaced = scratch(with_cuts(pages).withColumn("document_id", _file_key()), "pages")
    chars = written.agg(F.sum(F.length("page_text"))).first()[0] or 0
    slices = min(SLICES, 1 + chars // SLICE_CHARS)

    def part(rows: DataFrame, at: int) -> DataFrame:
        return one_slice(rows, "document_id", slices, at)

    placed, path = scratch(
        (placed_pages(_in_order(part(written, at))) for at in range(slices)), "long-pages"
    )
    remove(spark, unplaced)
    units = long_units(placed, slices=slices)
    marks = each(
        units,
        ["document_id", "unit"],
        F.transform("chunks", lambda c: let(_mark(c), _beginning)),
        "at",
        "mark",
    ).select("document_id", F.struct("unit", "at").alias("key"), "mark")
    found, _ = scratch(
        (
            found_pages(part(marks, at), part(placed, at), EARLY_PAGES)
            .groupBy("key.unit")
            .agg(
                F.map_from_entries(F.collect_list(F.struct("key.at", "page_number"))).alias("pages")
            )
            for at in range(slices)
        ),
        "found-pages",
    )
    remove(spark, path)
    labels, _ = scratch(first_ids(units).join(found, "unit", "left"), "chunk-numbers")
    located = F.transform(
        "chunks", lambda c, at: c.withField("page_number", F.try_element_at("pages", at))
    )
    numbered = numbered_chunks(units, labels, located)
    return _chunk_rows(numbered, _id_of_key()).withColumn("document_id", _id_of_key())


def _finished(chunks: DataFrame) -> DataFrame:
    law_date = F.to_date(lookup(F.col("document_id"), LAW_PASSED_DATES))
    return chunks.select(
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
        law_date.alias("law_passed_date"),
    )


def ordered_scan(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows in a presentation order; operators never depend on it."""
    return rows.orderBy(*order)


def orphan_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose text was found on no page."""
    return chunks.where(F.col("page_number").isNull())


def limit_chunks(chunks: DataFrame, count: int = 1) -> DataFrame:
    """The first chunks of every document, for trial runs."""
    return chunks.where(F.col("chunk_id") < count)
