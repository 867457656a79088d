"""Chunking of documents too long for one row.

The same chunks as ``chunking.chunk_array`` gives, without ever putting a
document together.  Its pages are regrouped into blocks that start and end with
ordinary text lines.  No cleaning rule and no heading reaches across such a
border, so each block is cleaned and cut by itself.  An article, annex or text without
headings that lies in one block is chunked there; the pieces of one that spans blocks are
joined, as are fixed windows, by their offset.  Only numbers, lengths, counts and the ends
of blocks are ordered per document; texts go through one shuffle into their blocks.

What must fit in a row is a block or an article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import chunking
from lexweave.functions.chunking import (
    ANNEX_HEADING,
    ANNEX_START,
    ARTICLE_HEADING,
    FALLBACK_OVERLAP,
    MAX_CHARS,
    PART_OVERLAP,
    let,
)
from lexweave.functions.text import (
    DELETED_CHARS,
    NOISE_LINES,
    clean_lines,
    lstrip,
    normalize_ws,
    rstrip,
    strip,
)
from lexweave.operators.rows import by_key, each, one_slice
from lexweave.storage import scratch

# Pages per block, roughly, and windows numbered together.
BLOCK_PAGES = 64
WINDOW_GROUP = 512

# Lines next to which a text cannot be cut: those that cleaning removes, and bare
# heading words whose number may follow on the next line.
_LOOSE_LINE = rf"^(?:{'|'.join(NOISE_LINES)}|(?i:Article)|ANNEX(?:ES)?)\z"

# Every block but a document's first holds at least one character and a newline.
_OVERLAP_BLOCKS = PART_OVERLAP // 2

_DOCUMENT = ("document_id", "file_name")
_ORDER = ("major", "minor", "part_group", "position")
_BEFORE = (Window.unboundedPreceding, -1)


def _is_firm(line: Column) -> Column:
    return let(strip(line), lambda text: (text != "") & ~text.rlike(_LOOSE_LINE))


def _plain_text() -> Column:
    return F.translate(F.coalesce("page_text", F.lit("")), DELETED_CHARS, "")


def with_cuts(pages: DataFrame) -> DataFrame:
    """Pages with what their own lines say of where a block may start."""
    return (
        pages.select(*_DOCUMENT, "page_number", "page_text")
        .withColumn("firm", F.transform(F.split(_plain_text(), "\n", -1), _is_firm))
        .withColumn("starts_firm", F.get("firm", F.lit(0)))
        .withColumn("ends_firm", F.element_at("firm", -1))
        .withColumn(
            "cut_after",
            F.array_position(
                F.zip_with(
                    "firm", F.slice("firm", 2, 1 << 30), lambda a, b: F.coalesce(a & b, F.lit(False))
                ),
                F.lit(True),
            ).cast("int"),
        )
        .drop("firm")
    )


def placed_pages(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Pages ``with_cuts`` and the block they belong to, partitioned by document.

    A block starts where its range of pages can first be cut, a document's first one with
    the first page.  ``cut_line`` is the line after which a page is cut, whose beginning
    belongs to ``block_before``.
    """
    in_range = Window.partitionBy("document_id", "range").orderBy("page_number")
    # Ranges are in the order of pages; named, they spare a second sort.
    in_document = Window.partitionBy("document_id").orderBy("range", "page_number")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    is_first = F.col("range") == F.col("first_block")
    return (
        pages.withColumn("range", F.floor(F.col("page_number") / block_pages))
        .withColumn(
            "opens",
            F.col("starts_firm") & F.coalesce(F.lag("ends_firm").over(in_range), F.lit(False)),
        )
        .withColumn("can_cut", F.col("opens") | (F.col("cut_after") > 0))
        .withColumn(
            "cuts",
            F.col("can_cut")
            & ~F.coalesce(F.max("can_cut").over(in_range.rowsBetween(*_BEFORE)), F.lit(False)),
        )
        .withColumn("first_block", F.first("range").over(in_document.rowsBetween(*so_far)))
        .withColumn(
            "block",
            F.last(F.when(F.col("cuts") | is_first, F.col("range")), ignorenulls=True).over(
                in_document.rowsBetween(*so_far)
            ),
        )
        .withColumn("block_before", F.lag("block").over(in_document))
        .withColumn("last_block", F.max("block").over(Window.partitionBy("document_id")))
        .withColumn(
            "cut_line",
            F.when(F.col("cuts") & ~F.col("opens") & ~is_first, F.col("cut_after")),
        )
        .select(
            *_DOCUMENT,
            "page_number",
            "page_text",
            "block",
            F.when(F.col("cut_line").isNotNull(), F.col("block_before")).alias("block_before"),
            "cut_line",
            "first_block",
            "last_block",
        )
    )


def clean_blocks(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Cleaned text per (document, block); joined by newlines in block order they
    are the cleaned document text."""
    if "cut_line" not in pages.columns:
        pages = placed_pages(with_cuts(pages), block_pages)
    lines, cut_line = F.split(_plain_text(), "\n", -1), F.col("cut_line")

    def piece(block: str, text: Column) -> Column:
        return F.struct(F.col(block).alias("block"), text.alias("piece"))

    pieces = F.when(cut_line.isNull(), F.array(piece("block", _plain_text()))).otherwise(
        F.array(
            piece("block_before", F.array_join(F.slice(lines, F.lit(1), cut_line), "\n")),
            piece("block", F.array_join(F.slice(lines, cut_line + 1, F.lit(1 << 30)), "\n")),
        )
    )
    rows = each(pages, [*_DOCUMENT, "page_number", "first_block", "last_block"], pieces, "at", "p")
    joined = (
        by_key(rows.select("*", "p.*").drop("p"), "document_id", "block")
        .groupBy(*_DOCUMENT, "block")
        .agg(
            F.array_sort(F.collect_list(F.struct("page_number", "at", "piece"))).alias("ps"),
            F.first("first_block").alias("first_block"),
            F.first("last_block").alias("last_block"),
        )
    )
    block, text = F.col("block"), F.col("text")
    cleaned = clean_lines(F.array_join(F.transform("ps", lambda p: p["piece"]), "\n"))
    return (
        joined.select(*_DOCUMENT, "block", "first_block", "last_block", cleaned.alias("text"))
        .withColumn("text", F.when(block == F.col("first_block"), lstrip(text)).otherwise(text))
        .withColumn("text", F.when(block == F.col("last_block"), rstrip(text)).otherwise(text))
        .drop("first_block", "last_block")
    )


def _facts(blocks: DataFrame) -> DataFrame:
    """(document, block, annex_block, body, annex): where the annexes of the document start
    and, for the block's part of either region, what lies before and behind it there."""

    def of(text: Column, heading: str) -> Column:
        return F.struct(
            (F.size(chunking.cut_at(text, heading)) - 1).alias("headings"),
            F.substring(text, -PART_OVERLAP, PART_OVERLAP).alias("tail"),
        )

    text, block, annex_block = F.col("text"), F.col("block"), F.col("annex_block")
    own, _ = scratch(
        blocks.withColumn(
            "parts", F.when(text.rlike(ANNEX_START), chunking.halves(text))
        ).select(
            "document_id",
            "block",
            F.col("parts").isNotNull().alias("has_annex"),
            of(text, ARTICLE_HEADING).alias("body"),
            of(text, ANNEX_HEADING).alias("annex"),
            F.when(
                F.col("parts").isNotNull(), of(F.get("parts", F.lit(0)), ARTICLE_HEADING)
            ).alias("body_half"),
            F.when(
                F.col("parts").isNotNull(), of(chunking.annex_part(F.col("parts")), ANNEX_HEADING)
            ).alias("annex_half"),
        ),
        "block-facts",
    )
    in_document = Window.partitionBy("document_id")
    placed = own.withColumn(
        "annex_block", F.min(F.when(F.col("has_annex"), block)).over(in_document)
    )
    is_cut = block == annex_block
    regions = (
        F.when(
            annex_block.isNull() | (block <= annex_block),
            F.when(is_cut, F.col("body_half")).otherwise(F.col("body")),
        ),
        F.when(block >= annex_block, F.when(is_cut, F.col("annex_half")).otherwise(F.col("annex"))),
    )
    in_order = Window.partitionBy("document_id", "region").orderBy("block")
    in_region = Window.partitionBy("document_id", "region")
    section = F.struct(block.alias("major"), F.col("headings").alias("minor"))
    ordered = (
        each(placed, ["document_id", "block", "annex_block"], F.array(*regions), "region", "f")
        .where(F.col("f").isNotNull())
        .select("document_id", "block", "annex_block", "region", "f.*")
        .withColumn(
            "earlier",
            F.last(F.when(F.col("headings") > 0, section), ignorenulls=True).over(
                in_order.rowsBetween(*_BEFORE)
            ),
        )
        .withColumn("first_block", F.min("block").over(in_region))
        .withColumn("is_last", block == F.max("block").over(in_region))
        .withColumn("headed", F.max("headings").over(in_region) > 0)
        .withColumn("tails", F.collect_list("tail").over(in_order.rowsBetween(-_OVERLAP_BLOCKS, -1)))
        .withColumn("before", F.array_join(F.concat("tails", F.array(F.lit(""))), "\n"))
    )
    fact = F.struct("first_block", "is_last", "headed", "earlier", "before")
    return ordered.groupBy("document_id", "block").agg(
        F.first("annex_block").alias("annex_block"),
        F.max(F.when(F.col("region") == 0, fact)).alias("body"),
        F.max(F.when(F.col("region") == 1, fact)).alias("annex"),
    )


def _sections(blocks: DataFrame) -> DataFrame:
    """Pieces of sections, one from each block a section touches: the chunks of those that
    lie in one block, and the text ``raw`` of those that are ``open`` to another one.

    A section starts at a heading and is known by the block (major) and number (minor) of
    that heading; the text before the first heading is section 0 of the first block, and left
    out where there are headings.  ``overlap`` is the text just in front of the section,
    given with its first piece; it is empty for the first section with a heading.
    """
    block, annex_block, text = F.col("block"), F.col("annex_block"), F.col("text")
    is_cut = block == annex_block
    joined = blocks.join(_facts(blocks), ["document_id", "block"]).withColumn(
        "parts", F.when(is_cut, chunking.halves(text))
    )

    def region(fact: str, part: Column, heading: str) -> Column:
        own = F.when(is_cut, part).otherwise(text)
        return F.when(
            F.col(fact).isNotNull(),
            F.struct(F.col(fact).alias("fact"), chunking.cut_at(own, heading).alias("segments")),
        )

    regions = F.array(
        region("body", F.get("parts", F.lit(0)), ARTICLE_HEADING),
        region("annex", chunking.annex_part(F.col("parts")), ANNEX_HEADING),
    )

    def segment(raw: Column, i: Column) -> Column:
        before = F.slice(
            F.col("segments"),
            F.greatest(i - chunking.OVERLAP_SEGMENTS + 1, F.lit(1)),
            F.least(i, F.lit(chunking.OVERLAP_SEGMENTS)),
        )
        in_block = F.substring(F.array_join(before, ""), -PART_OVERLAP, PART_OVERLAP)
        return F.struct(raw.alias("raw"), F.when(i > 0, in_block).alias("in_block"))

    cut = each(joined, [*_DOCUMENT, "block"], regions, "region", "r").where(F.col("r").isNotNull())
    i, headed = F.col("i"), F.col("headed")
    preamble = F.struct(F.col("first_block").alias("major"), F.lit(0).alias("minor"))
    pieces = (
        each(
            cut.select(*_DOCUMENT, "block", "region", "r.fact.*", "r.segments"),
            [
                *(*_DOCUMENT, "block", "region", "first_block", "is_last", "headed", "earlier"),
                "before",
                F.size("segments").alias("segment_count"),
            ],
            F.transform("segments", segment),
            "i",
            "s",
        )
        .withColumn(
            "section",
            F.when(i > 0, F.struct(block.alias("major"), i.alias("minor"))).otherwise(
                F.coalesce("earlier", preamble)
            ),
        )
        .where(~headed | (F.col("section.minor") > 0))
        .withColumn(
            "overlap",
            F.when(
                (i > 1) | F.col("earlier").isNotNull(),
                F.substring(F.concat("before", "s.in_block"), -PART_OVERLAP, PART_OVERLAP),
            ).otherwise(F.lit("")),
        )
        .withColumn(
            "open",
            ~(((i > 0) | (block == F.col("first_block"))) & ((i + 1 < F.col("segment_count")) | F.col("is_last"))),
        )
        .select(
            *(*_DOCUMENT, "region", "headed", "block", "section.*", "open", "s.raw"),
            F.when(i > 0, F.col("overlap")).alias("overlap"),
        )
    )
    raw = F.col("raw")
    number = F.when(F.col("minor") > 0, chunking.annex_number(raw))
    chunks = (
        F.when(
            (F.col("region") == 0) & headed,
            let(chunking.article_entry(raw, F.col("overlap")), chunking.chunks_of_article),
        )
        .when(F.col("region") == 0, chunking.fallback_chunks(rstrip(raw)))
        .otherwise(let(chunking.annex_entry(raw, number), chunking.chunks_of_annex))
    )
    return pieces.withColumn("chunks", F.when(~F.col("open"), chunks)).withColumns(
        {c: F.when(F.col("open"), F.col(c)) for c in ("raw", "overlap")}
    )


def _article_units(pieces: DataFrame) -> DataFrame:
    articles = pieces.groupBy(*_DOCUMENT, "major", "minor").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda p: p["raw"]
            ),
            "\n",
        ).alias("raw"),
        F.max("overlap").alias("overlap"),
    )
    entry = chunking.article_entry(F.col("raw"), F.col("overlap"))
    return articles.select(
        *_DOCUMENT,
        "major",
        F.lit(0).alias("minor"),
        F.lit(0).alias("part_group"),
        F.col("minor").alias("position"),
        let(entry, chunking.chunks_of_article).alias("chunks"),
    )


def _annex_units(annexes: DataFrame) -> DataFrame:
    """Annexes by windows, since an annex may be most of a document."""
    pieces = annexes.withColumn(
        "text",
        F.when(F.col("block") == F.col("major"), lstrip(F.col("raw"))).otherwise(F.col("raw")),
    )
    section = ["document_id", "major", "minor"]
    placed = _with_start(pieces, section)
    firm = rstrip(F.col("text"))
    facts = placed.groupBy(*section).agg(
        F.max(
            F.when(
                (F.col("block") == F.col("major")) & (F.col("minor") > 0),
                chunking.annex_number(F.col("raw")),
            )
        ).alias("number"),
        F.max(F.when(firm != "", F.col("start") + F.length(firm))).alias("chars"),
    )
    step = MAX_CHARS - PART_OVERLAP
    is_split = F.col("chars") > MAX_CHARS
    chunk = chunking.chunk_struct(
        "annex",
        normalize_ws(F.col("text")),
        annex=F.col("number"),
        title=chunking.annex_title(F.col("number")),
        index=F.col("window"),
        count=F.when(is_split, F.ceil(F.col("chars") / step)).otherwise(F.lit(1)),
    )
    return (
        _window_texts(placed, ["major", "minor"], PART_OVERLAP)
        .join(facts, section)
        .where((F.col("window") == 0) | (is_split & (F.col("window") * step < F.col("chars"))))
        .select(
            *_DOCUMENT,
            "major",
            "minor",
            F.expr(f"window div {WINDOW_GROUP}").alias("part_group"),
            F.col("window").alias("position"),
            F.array(chunk).alias("chunks"),
        )
    )


def _fallback_units(pieces: DataFrame) -> DataFrame:
    """Fixed windows over a whole body."""
    body = pieces.select(*_DOCUMENT, "block", F.col("raw").alias("text"))
    texts = _window_texts(_with_start(body, ["document_id"]), [], FALLBACK_OVERLAP)
    return texts.select(
        *_DOCUMENT,
        F.lit(0).alias("major"),
        F.lit(0).alias("minor"),
        F.expr(f"window div {WINDOW_GROUP}").alias("part_group"),
        F.col("window").alias("position"),
        chunking.chunks_of_windows(F.array("text")).alias("chunks"),
    )


def _with_start(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Pieces with their offset in the text that they make up, joined by newlines."""
    in_order = Window.partitionBy(*key).orderBy("block").rowsBetween(*_BEFORE)
    starts = pieces.select(
        *key, "block", (F.length("text") + 1).cast("bigint").alias("chars")
    ).select(
        *key, "block", F.coalesce(F.sum("chars").over(in_order), F.lit(0)).alias("start")
    )
    return pieces.join(starts, [*key, "block"])


def _window_texts(placed: DataFrame, key: list[str], overlap: int) -> DataFrame:
    """Windows (document, key, window, text) put together from the pieces they touch."""
    step = MAX_CHARS - overlap
    rows = placed.withColumn("text", F.concat("text", F.lit("\n")))
    first = F.greatest(F.ceil((F.col("start") - MAX_CHARS + 1) / step), F.lit(0))
    last = F.floor((F.col("start") + F.length("text") - 1) / step)
    begin = F.col("window") * step - F.col("start")
    piece = F.col("text").substr(
        (F.greatest(begin, F.lit(0)) + 1).cast("int"),
        (F.least(begin + MAX_CHARS, F.length("text")) - F.greatest(begin, F.lit(0))).cast("int"),
    )
    return (
        rows.withColumn("window", F.explode(F.sequence(first, last)))
        .select(*_DOCUMENT, *key, "block", "window", piece.alias("piece"))
        .groupBy(*_DOCUMENT, *key, "window")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("block", "piece"))),
                    lambda p: p["piece"],
                ),
                "",
            ).alias("text")
        )
    )


def long_units(
    pages: DataFrame, block_pages: int = BLOCK_PAGES, slices: int = 1
) -> DataFrame:
    """Units of chunks, written: (document, unit, region, major, minor, part_group, position,
    chunk_count, chunks).  ``unit`` is a number of its own; region to position order the
    units of a document.  Documents are dealt into ``slices`` that are handled in turn."""

    def numbers(at: int) -> Column:
        return F.monotonically_increasing_id() * slices + at

    def part(rows: DataFrame, at: int) -> DataFrame:
        return one_slice(rows, "document_id", slices, at)

    sections, _ = scratch(
        (
            _sections(clean_blocks(part(pages, at), block_pages))
            .withColumn("chunk_count", F.size("chunks"))
            .withColumn("unit", numbers(at))
            for at in range(slices)
        ),
        "sections",
    )
    is_article = (F.col("region") == 0) & F.col("headed")
    is_annex = F.col("region") == 1
    zero = F.lit(0)

    def ordered(units: DataFrame, region: Column) -> DataFrame:
        return units.select(
            *_DOCUMENT,
            "unit",
            region.alias("region"),
            *[F.col(c).cast("bigint").alias(c) for c in _ORDER],
            "chunk_count",
            "chunks",
        )

    units = ordered(
        sections.where(~F.col("open") & (F.col("chunk_count") > 0)).withColumns(
            {
                "position": F.when(is_article, F.col("minor")).otherwise(zero),
                "part_group": zero,
                "major": F.when(is_article | is_annex, F.col("major")).otherwise(zero),
                "minor": F.when(is_annex, F.col("minor")).otherwise(zero),
            }
        ),
        F.col("region"),
    )
    pieces = sections.where("open").drop("chunks", "chunk_count", "unit")
    if pieces.isEmpty():
        return units

    def joined(rows: DataFrame, region: int) -> DataFrame:
        numbered = rows.withColumn("chunk_count", F.size("chunks")).withColumn("unit", zero)
        return ordered(numbered.where("chunk_count > 0"), F.lit(region))

    def of_pieces(pieces: DataFrame) -> DataFrame:
        body = pieces.where(~is_article & ~is_annex)
        return (
            joined(_article_units(pieces.where(is_article)), 0)
            .unionByName(joined(_fallback_units(body), 0))
            .unionByName(joined(_annex_units(pieces.where(is_annex)), 1))
        )

    across, _ = scratch(
        # Numbered below the others.
        (of_pieces(part(pieces, at)).withColumn("unit", -1 - numbers(at)) for at in range(slices)),
        "units-across-blocks",
    )
    return units.unionByName(across)


def first_ids(units: DataFrame) -> DataFrame:
    """(unit, first_id): the number of a unit's first chunk in its document.

    Chunks are numbered by group totals first, then within each group.
    """
    key = ["document_id", "region", *_ORDER[:-1]]
    counts = units.select(*key, "position", "unit", "chunk_count")
    before_group = Window.partitionBy("document_id").orderBy(*key[1:]).rowsBetween(*_BEFORE)
    starts = (
        counts.groupBy(*key)
        .agg(F.sum("chunk_count").alias("chunk_total"))
        .select(
            *key,
            F.coalesce(F.sum("chunk_total").over(before_group), F.lit(0)).alias("group_start"),
        )
    )
    before_unit = Window.partitionBy(*key).orderBy("position").rowsBetween(*_BEFORE)
    return counts.join(starts, key).select(
        "unit",
        (
            F.col("group_start") + F.coalesce(F.sum("chunk_count").over(before_unit), F.lit(0))
        ).alias("first_id"),
    )


def numbered_chunks(units: DataFrame, numbers: DataFrame, chunks: Column) -> DataFrame:
    """(document_id, file_name, chunk_id, c) rows of units and their ``first_ids``."""
    rows = units.select(*_DOCUMENT, "unit", "chunks").join(numbers, "unit")
    return each(rows, [*_DOCUMENT, "first_id"], chunks, "at", "c").select(
        *_DOCUMENT, (F.col("first_id") + F.col("at")).cast("int").alias("chunk_id"), "c"
    )


def chunk_long_documents(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(document_id, file_name, chunk_id, c) rows, ``c`` being the chunk struct."""
    units = long_units(pages, block_pages)
    return numbered_chunks(units, first_ids(units), F.col("chunks"))
