from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T


def test_clean_text_blanks_noise_lines_and_squeezes(evaluate):
    raw = " \nEN\nL 119/1\n4.5.2016\nBody\u00adtext\ufffe  with\t gaps\n\n\n\nEND \n"
    assert evaluate(lambda X: T.clean_text(X), x=raw) == "Bodytext with gaps\n\nEND"


def test_clean_text_keeps_lines_that_only_contain_noise(evaluate):
    raw = "L 119/1 and more\nIn EN language\n14.5.2016 is a date"
    assert evaluate(lambda X: T.clean_text(X), x=raw) == raw


def test_blank_lines_next_to_noise_are_swallowed(evaluate):
    assert evaluate(lambda X: T.clean_text(X), x="a\n\n\n EN \n\n\nb") == "a\n\nb"


@pytest.mark.parametrize("space", ["\u00a0", "\u2003", "\x0b", "\x1c", "\u3000", "\r\n", " \t "])
def test_normalize_ws_knows_unicode_spaces(evaluate, space):
    assert evaluate(lambda X: T.normalize_ws(X), x=f"{space}a{space}b{space * 2}c{space}") == "a b c"


def test_match_form_lowers(evaluate):
    assert evaluate(lambda X: T.match_form(X), x=" Die  STRASSE ") == "die strasse"


@pytest.mark.parametrize(
    "written, expected",
    [
        ("27 April 2016", datetime.date(2016, 4, 27)),
        ("31 April 2016", None),
        ("7 may 2016", datetime.date(2016, 5, 7)),
        ("27 foo 2016", None),
    ],
)
def test_parse_law_date(evaluate, written, expected):
    assert evaluate(lambda X: T.parse_law_date(X), x=written) == expected


def test_metadata_with_short_title(evaluate):
    page = (
        "REGULATION (EU) 2016/679 OF THE EUROPEAN PARLIAMENT AND OF THE COUNCIL\n"
        "of 27 April\n2016\n(General Data Protection Regulation)"
    )
    meta = evaluate(lambda X: T.document_metadata(X), x=page)
    assert meta.asDict() == {
        "regulation_title": "General Data Protection Regulation",
        "document_version": "2016/679",
        "law_passed_date": datetime.date(2016, 4, 27),
        "issuing_authority": "European Parliament and Council of the European Union",
    }


def test_metadata_falls_back_to_kind_and_version(evaluate):
    meta = evaluate(lambda X: T.document_metadata(X), x="DIRECTIVE 2014/65/EU of 15 May 2014")
    assert meta["regulation_title"] == "Directive 2014/65/EU"
    assert meta["document_version"] == "2014/65/EU"
    assert meta["issuing_authority"] is None


def test_metadata_of_an_unrelated_page_is_null(evaluate):
    assert set(evaluate(lambda X: T.document_metadata(X), x="Just text").asDict().values()) == {None}


def test_html_escape(evaluate):
    assert evaluate(lambda X: T.html_escape(X), x="<a href=\"x\">'&amp;'\n") == (
        "&lt;a href=&quot;x&quot;&gt;&#039;&amp;amp;&#039;<br>"
    )


def test_first_non_empty_skips_empty_strings(evaluate):
    assert evaluate(
        lambda X: T.first_non_empty(F.lit(""), F.lit(None).cast("string"), X), x="x"
    ) == "x"
    assert evaluate(lambda X: T.first_non_empty(F.lit(""), F.nullif(X, X)), x="x") == ""


def test_first_non_zero(evaluate):
    assert evaluate(lambda X: T.first_non_zero(F.lit(0), X), x=4) == 4
    assert evaluate(lambda X: T.first_non_zero(F.lit(0), X), x=0) is None


def test_preview_counts_code_points(evaluate):
    assert evaluate(lambda X: T.preview(X, 3), x="\U0001d4b3\u00e9\u00fcz") == "\U0001d4b3\u00e9\u00fc"
