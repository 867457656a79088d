"""Text expressions: cleaning, normalising, document metadata, escaping.

Patterns ask for Unicode white space (``(?U)``), digits and word characters, because
the JVM's ``\\s``, ``\\d`` and ``\\w`` are ASCII-only by default.  Line anchors use
``(?d)`` so that only ``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed character classes.  WS_CHARS lists what WS matches.
WS_CHARS = "".join(
    chr(point)
    for first, last in (
        (0x09, 0x0D),
        (0x1C, 0x20),
        (0x85, 0x85),
        (0xA0, 0xA0),
        (0x1680, 0x1680),
        (0x2000, 0x200A),
        (0x2028, 0x2029),
        (0x202F, 0x202F),
        (0x205F, 0x205F),
        (0x3000, 0x3000),
    )
    for point in range(first, last + 1)
)
# Patterns with WS in them need the U flag.
WS = r"[\s\x1c-\x1f]"
# Runs that are not already a single space.
WS_RUN = rf"(?U){WS}{{2,}}|[\s\x1c-\x1f&&[^ ]]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Characters deleted and whole lines blanked by cleaning, in order.
DELETED_CHARS = chr(0xAD) + chr(0xFFFE)
NOISE_LINES = (
    rf"{DIGIT}{{1,2}}\.{DIGIT}{{1,2}}\.{DIGIT}{{4}}",
    rf"L {DIGIT}+/{DIGIT}+",
    "EN",
    "Official Journal of the European Union",
)

# Cleaning deletes this character, so it is free to mark cut points afterwards.
CUT = chr(0xFFFE)

# What the title page of a regulation looks like.
VERSION_PATTERN = r"\(EU\)\s+(\d{4}/\d+(?:/EU)?)"
VERSION_FALLBACK_PATTERN = r"(?:REGULATION|DIRECTIVE)\s+(\d{4}/\d+/EU)"
DATE_PATTERN = (
    rf"(?<!{WORD})of\s+(\d{{1,2}}\s+{WORD}+\s+\d{{4}})(?!{WORD})"
)
SHORT_TITLE_PATTERN = (
    r"\(([A-Z][A-Za-z\s\-]+(?:Act|Regulation|Directive|Framework|Mechanism))\)"
)
KIND_PATTERN = r"^(REGULATION|DIRECTIVE)"
AUTHORITY_PHRASE = "EUROPEAN PARLIAMENT AND OF THE COUNCIL"
AUTHORITY_NAME = "European Parliament and Council of the European Union"

# Entity escapes for display; the ampersand comes first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#039;"),
    ("\n", "<br>"),
)


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.trim(text, F.lit(WS_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def non_empty(text: Column) -> Column:
    """Turn an empty string into null."""
    return F.nullif(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """Remove soft hyphens, running headers and surplus blanks from page text."""
    return strip(clean_lines(text))


def clean_lines(text: Column) -> Column:
    """``clean_text`` but for the stripping, so that it applies to part of a text."""
    out = text
    for char in DELETED_CHARS:
        out = F.replace(out, F.lit(char), F.lit(""))
    for line in NOISE_LINES:
        out = F.regexp_replace(out, rf"(?mdU)^{WS}*{line}{WS}*$", "")
    out = F.regexp_replace(F.replace(out, F.lit("\t"), F.lit(" ")), "  +", " ")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def normalize_ws(text: Column) -> Column:
    """Collapse every run of white space to one space and strip the ends."""
    return strip(F.regexp_replace(text, WS_RUN, " "))


def match_form(text: Column) -> Column:
    """The lower-case, single-spaced form in which texts are compared."""
    return F.lower(normalize_ws(text))


def parse_law_date(text: Column) -> Column:
    """``27 April 2016`` as a date; null when the day does not exist."""
    return F.try_to_date(text, "d MMMM yyyy")


def document_metadata(first_page: Column) -> Column:
    """Title, version, date and authority read off a document's first page."""
    text = normalize_ws(first_page)

    def group(pattern: str) -> Column:
        return non_empty(F.regexp_extract(text, pattern, 1))

    version = F.coalesce(group(VERSION_PATTERN), group(VERSION_FALLBACK_PATTERN))
    titled = strip(group(SHORT_TITLE_PATTERN))
    generic = F.concat(F.initcap(group(KIND_PATTERN)), F.lit(" "), version)
    return F.struct(
        F.coalesce(titled, generic).alias("regulation_title"),
        version.alias("document_version"),
        parse_law_date(group(DATE_PATTERN)).alias("law_passed_date"),
        F.when(text.contains(AUTHORITY_PHRASE), F.lit(AUTHORITY_NAME)).alias(
            "issuing_authority"
        ),
    )


def html_escape(text: Column) -> Column:
    for plain, entity in HTML_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def preview(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def first_non_empty(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else the empty string."""
    return F.coalesce(*[non_empty(t) for t in texts], F.lit(""))


def first_non_zero(*numbers: Column) -> Column:
    """The first number that is neither null nor zero, else null."""
    return F.coalesce(*[F.nullif(n, F.lit(0)) for n in numbers])
