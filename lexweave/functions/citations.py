"""Expressions over generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How an answer cites, and how it says that it cannot answer.
PAGED_CITATION = r"(\[(?:Document|Source):[^\]]*?[Pp]age\s+(\d+)[^\]]*?\])"
ANY_CITATION = r"(\[(?:Document|Source):[^\]]+\])"
INSUFFICIENT = (
    "The provided document excerpts do not contain sufficient information "
    "to answer this question"
)


def is_insufficient(answer: Column) -> Column:
    return answer.contains(INSUFFICIENT)


def citations(answer: Column) -> Column:
    """Array of (citation, page); answers without context keep citations unpaged."""
    paged = F.arrays_zip(
        F.regexp_extract_all(answer, F.lit(PAGED_CITATION), F.lit(1)).alias("citation"),
        F.transform(
            F.regexp_extract_all(answer, F.lit(PAGED_CITATION), F.lit(2)),
            lambda page: page.try_cast("int"),
        ).alias("page"),
    )
    unpaged = F.transform(
        F.regexp_extract_all(answer, F.lit(ANY_CITATION), F.lit(1)),
        lambda citation: F.struct(
            citation.alias("citation"), F.lit(None).cast("int").alias("page")
        ),
    )
    return F.when(is_insufficient(answer), unpaged).otherwise(paged)
