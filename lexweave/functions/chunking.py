"""Structural chunking of one document text into an array of chunk structs.

Everything is an expression over the text of a row, so a document is chunked
where it lies: no shuffle, no Python.  Windows are cut in one linear regex pass;
repeated ``substring`` calls would rescan a UTF-8 string from its start each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import (
    CUT,
    DIGIT,
    LINE_BREAK,
    WORD,
    WS,
    clean_text,
    match_form,
    non_empty,
    normalize_ws,
    rstrip,
    strip,
)

# Chunk sizes in characters.
MAX_CHARS = 900
PART_OVERLAP = 50
FALLBACK_OVERLAP = 150
TITLE_MAX_CHARS = 150
TITLE_LINES = 3

# The structure of a regulation text.
ARTICLE_HEADING = rf"(?mdiU)^{WS}*Article{WS}+({DIGIT}+[A-Za-z]?){WS}*$"
ANNEX_START = rf"(?mdU)^{WS}*ANNEX(?:ES)?(?!{WORD})"
ANNEX_HEADING = rf"(?mdU)^{WS}*ANNEX(?:ES)?{WS}+([IVX]+)?{WS}*$"
PARAGRAPH_BREAK = rf"(?U)\n(?=(?:\([A-Za-z0-9]+\)|{DIGIT}+\.){WS})"
NOT_A_TITLE = rf"^(?:{DIGIT}+\.|\({DIGIT}+\)|L {DIGIT}+/{DIGIT}+)|Official Journal|^EN$"
FIRST_PARAGRAPH_MARK = rf"(?sU)((?:\({WORD}+\)|{DIGIT}+\.){WS}.*)"

# Prefix lengths tried, longest first, when looking for a page.
PAGE_TIERS = (200, 100, 50)

# Segments are at least this long, so the overlap in front of an article reaches
# back over at most this many of them.
OVERLAP_SEGMENTS = -(-PART_OVERLAP // len("Article 1"))

# A slice length beyond any array.
_TO_END = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _null_string() -> Column:
    return F.lit(None).cast("string")


def _drop_first(items: Column) -> Column:
    return F.slice(items, 2, _TO_END)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters starting every ``size - overlap``."""
    step = size - overlap
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    return let(
        blocks,
        lambda bs: F.zip_with(
            bs,
            _drop_first(bs),
            lambda block, after: F.concat(
                block, F.coalesce(F.substring(after, 1, overlap), F.lit(""))
            ),
        ),
    )


def hard_split(text: Column) -> Column:
    """The text itself if short enough, else overlapping windows."""
    return F.when(
        F.length(text) > MAX_CHARS, windows(text, MAX_CHARS, PART_OVERLAP)
    ).otherwise(F.array(text))


def halves(cleaned: Column) -> Column:
    """The text before the first annex line and, if there is one, what follows."""
    return F.split(F.regexp_replace(cleaned, f"({ANNEX_START})", f"{CUT}$1"), CUT, 2)


def _body(parts: Column) -> Column:
    return rstrip(F.get(parts, F.lit(0)))


def annex_part(parts: Column) -> Column:
    return F.translate(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), CUT, "")


def _annex(parts: Column) -> Column:
    return strip(annex_part(parts))


def split_body_annex(cleaned: Column) -> Column:
    """Struct of the body and the annex text (empty when there is no annex)."""
    return let(
        halves(cleaned),
        lambda h: F.struct(_body(h).alias("body"), _annex(h).alias("annex")),
    )


def cut_at(text: Column, heading: str) -> Column:
    """Split before every heading; element 0 is what precedes the first one."""
    return F.split(F.regexp_replace(text, f"({heading})", f"{CUT}$1"), CUT, -1)


def article_title(article: Column) -> Column:
    """The first of lines two to four that reads like a title, else null."""
    lines = F.filter(
        F.transform(F.split(article, LINE_BREAK), strip), lambda line: line != ""
    )
    return F.get(
        F.filter(
            F.slice(lines, 2, TITLE_LINES),
            lambda line: (F.length(line) <= TITLE_MAX_CHARS) & ~line.rlike(NOT_A_TITLE),
        ),
        F.lit(0),
    )


def pack_paragraphs(paragraphs: Column, header: Column) -> Column:
    """Greedily join two or more paragraphs up to the limit; later groups open
    with the header."""

    def step(state: Column, paragraph: Column) -> Column:
        fits = F.length(state["open"]) + F.length(paragraph) + 1 <= MAX_CHARS
        return F.struct(
            F.when(fits, state["done"])
            .otherwise(F.array_append(state["done"], state["open"]))
            .alias("done"),
            F.concat(
                F.when(fits, state["open"]).otherwise(header), F.lit("\n"), paragraph
            ).alias("open"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array_join(F.slice(paragraphs, 1, 2), "\n").alias("open"),
    )
    return F.aggregate(
        F.slice(paragraphs, 3, _TO_END),
        start,
        step,
        lambda state: F.array_append(state["done"], state["open"]),
    )


def split_oversized(article: Column, number: Column, title: Column) -> Column:
    """Parts of an article over the limit: packed paragraphs, then windows."""
    header = F.concat_ws(" ", F.lit("Article"), number, title)
    return let(
        F.split(article, PARAGRAPH_BREAK),
        lambda paragraphs: F.when(F.size(paragraphs) <= 1, hard_split(article)).otherwise(
            let(
                header,
                lambda h: F.flatten(F.transform(pack_paragraphs(paragraphs, h), hard_split)),
            )
        ),
    )


def article_entry(raw: Column, overlap: Column) -> Column:
    """(number, title, article, parts) of the text from one heading to the next,
    given the characters in front of it."""

    def with_parts(number: Column, title: Column, article: Column) -> Column:
        return F.struct(
            number.alias("number"),
            title.alias("title"),
            article.alias("article"),
            F.when(F.length(article) <= MAX_CHARS, F.array(F.concat(overlap, raw)))
            .otherwise(split_oversized(article, number, title))
            .alias("parts"),
        )

    return let(
        F.struct(
            F.regexp_extract(raw, ARTICLE_HEADING, 1).alias("number"),
            strip(raw).alias("article"),
        ),
        lambda a: let(
            article_title(a["article"]),
            lambda title: with_parts(a["number"], title, a["article"]),
        ),
    )


def articles_of(body: Column) -> Column:
    """Array of (number, title, article, parts), one per article heading."""

    def entries(segments: Column) -> Column:
        def entry(raw: Column, i: Column) -> Column:
            before = F.slice(
                segments,
                F.greatest(i - OVERLAP_SEGMENTS + 1, F.lit(1)),
                F.least(i, F.lit(OVERLAP_SEGMENTS)),
            )
            overlap = F.when(
                i > 1, F.substring(F.array_join(before, ""), -PART_OVERLAP, PART_OVERLAP)
            ).otherwise(F.lit(""))
            return let(
                overlap, lambda text: F.when(i > 0, article_entry(raw, text))
            )

        return _drop_first(F.transform(segments, entry))

    return let(cut_at(body, ARTICLE_HEADING), entries)


def annex_title(number: Column) -> Column:
    return F.concat_ws(" ", F.lit("Annex"), number)


def annex_entry(raw: Column, number: Column) -> Column:
    """(number, text, parts) of one annex."""
    return let(
        strip(raw),
        lambda text: F.struct(
            number.alias("number"), text.alias("text"), hard_split(text).alias("parts")
        ),
    )


def annex_number(raw: Column) -> Column:
    return non_empty(F.regexp_extract(raw, ANNEX_HEADING, 1))


def annexes_of(annex: Column) -> Column:
    """Array of (number, text, parts); without a heading the whole text is one."""

    def entries(segments: Column) -> Column:
        return F.when(
            F.size(segments) <= 1, F.array(annex_entry(annex, _null_string()))
        ).otherwise(
            F.transform(
                _drop_first(segments), lambda raw: annex_entry(raw, annex_number(raw))
            )
        )

    return let(cut_at(annex, ANNEX_HEADING), entries)


def chunk_struct(
    kind: str,
    text: Column,
    *,
    article: Column | None = None,
    annex: Column | None = None,
    title: Column | None = None,
    index: Column | None = None,
    count: Column | None = None,
) -> Column:
    def text_or_null(value: Column | None) -> Column:
        return _null_string() if value is None else value

    def int_or(value: Column | None, default: int) -> Column:
        return (F.lit(default) if value is None else value).cast("int")

    return F.struct(
        F.lit(kind).alias("chunk_type"),
        text_or_null(article).alias("article_number"),
        text_or_null(annex).alias("annex_number"),
        text_or_null(title).alias("title"),
        int_or(index, 0).alias("part_index"),
        int_or(count, 1).alias("part_count"),
        text.alias("chunk_text"),
    )


def chunks_of_article(a: Column) -> Column:
    return F.transform(
        a["parts"],
        lambda part, i: chunk_struct(
            "article",
            normalize_ws(part),
            article=a["number"],
            title=a["title"],
            index=i,
            count=F.size(a["parts"]),
        ),
    )


def article_chunks(body: Column) -> Column:
    return F.flatten(F.transform(articles_of(body), chunks_of_article))


def chunks_of_annex(a: Column) -> Column:
    return F.transform(
        a["parts"],
        lambda part, i: chunk_struct(
            "annex",
            normalize_ws(part),
            annex=a["number"],
            title=annex_title(a["number"]),
            index=i,
            count=F.size(a["parts"]),
        ),
    )


def annex_chunks(annex: Column) -> Column:
    chunks = F.flatten(F.transform(annexes_of(annex), chunks_of_annex))
    return F.filter(chunks, lambda _: annex != "")


def fallback_chunks(body: Column) -> Column:
    """Fixed windows, for texts without a single article heading."""
    return chunks_of_windows(windows(body, MAX_CHARS, FALLBACK_OVERLAP))


def chunks_of_windows(texts: Column) -> Column:
    filled = F.filter(F.transform(texts, normalize_ws), lambda t: t != "")
    return F.transform(filled, lambda t: chunk_struct("fallback", t))


def chunk_array(text: Column) -> Column:
    """All chunks of a raw document text, in order: articles (else fallback
    windows), then annexes."""

    def assemble(parts: Column) -> Column:
        body_chunks = let(
            _body(parts),
            lambda body: let(
                article_chunks(body),
                lambda articles: F.when(F.size(articles) > 0, articles).otherwise(
                    fallback_chunks(body)
                ),
            ),
        )
        return F.concat(body_chunks, let(_annex(parts), annex_chunks))

    return let(halves(clean_text(text)), assemble)


def chunk_uid(
    document_id: Column,
    chunk_type: Column,
    article_number: Column,
    annex_number: Column,
    part_index: Column,
    chunk_id: Column,
) -> Column:
    """Readable label of a chunk; not unique when a heading number repeats."""
    part = F.concat(F.lit("_p_"), part_index)
    return F.concat(
        document_id,
        F.when(
            (chunk_type == "article") & non_empty(article_number).isNotNull(),
            F.concat(F.lit("_art_"), article_number, part),
        )
        .when(
            (chunk_type == "annex") & non_empty(annex_number).isNotNull(),
            F.concat(F.lit("_ann_"), annex_number, part),
        )
        .otherwise(F.concat(F.lit("_chunk_"), chunk_id)),
    )


def fingerprint(
    chunk_text: Column,
    chunk_type: Column,
    article_number: Column,
    annex_number: Column,
    part_index: Column,
) -> Column:
    """The part of a chunk that should occur verbatim on its page, in match form."""

    def from_target(target: Column) -> Column:
        at = F.instr(chunk_text, target)
        return F.when(at > 0, F.substring(chunk_text, at, F.length(chunk_text))).otherwise(
            chunk_text
        )

    has_article = non_empty(article_number).isNotNull()
    start = (
        F.when(
            (part_index > 0) & has_article,
            F.coalesce(
                non_empty(F.regexp_extract(chunk_text, FIRST_PARAGRAPH_MARK, 1)), chunk_text
            ),
        )
        .when(
            (chunk_type == "article") & has_article,
            from_target(F.concat(F.lit("Article "), article_number)),
        )
        .when(
            (chunk_type == "annex") & non_empty(annex_number).isNotNull(),
            from_target(F.concat(F.lit("ANNEX "), annex_number)),
        )
        .otherwise(chunk_text)
    )
    return match_form(start)


def locate_page(mark: Column, pages: Column) -> Column:
    """1-based position of the page that contains the longest prefix of ``mark``.

    ``pages`` is the array of the document's pages in match form.  The longest
    tier wins, then the first page; null when no tier is found.
    """

    def tier(length: int) -> Column:
        return let(
            F.substring(mark, 1, length),
            lambda prefix: F.nullif(
                F.array_position(
                    F.transform(pages, lambda page: F.contains(page, prefix)), F.lit(True)
                ),
                F.lit(0),
            ),
        )

    return F.when(mark != "", F.coalesce(*[tier(n) for n in PAGE_TIERS])).cast("int")
