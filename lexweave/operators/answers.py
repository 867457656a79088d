"""What is read out of generated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.citations import citations, is_insufficient
from lexweave.functions.text import first_non_empty
from lexweave.operators.rows import each


def extract_citations(answers: DataFrame) -> DataFrame:
    """One row per citation, numbered within its answer."""
    found = each(answers, ["answer_id"], citations(F.col("answer")), "position", "c")
    return found.select("answer_id", "position", "c.citation", "c.page")


def insufficient_answers(answers: DataFrame) -> DataFrame:
    return answers.where(is_insufficient(F.col("answer")))


def citation_page_map(retrieved: DataFrame) -> DataFrame:
    """Per answer and page the file and title of the last retrieved chunk there."""
    entry = F.struct(
        F.col("source_file").alias("file"),
        first_non_empty(F.col("regulation_title"), F.col("title")).alias("title"),
    )
    return (
        retrieved.where(F.col("page").isNotNull())
        .groupBy("answer_id", "page")
        .agg(F.max_by(entry, "rank").alias("entry"))
        .select("answer_id", "page", "entry.*")
    )


def link_citations(cited: DataFrame, page_map: DataFrame) -> DataFrame:
    """Citations with the file and title of their page; unmatched ones unlinked."""
    return cited.join(page_map, ["answer_id", "page"], "left").select(
        "answer_id",
        "position",
        "citation",
        "page",
        "file",
        "title",
        F.col("file").isNotNull().alias("linked"),
    )
