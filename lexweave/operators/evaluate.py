"""Scoring of answers against verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.vectors import cosine_similarity


def faithfulness(statements: DataFrame) -> DataFrame:
    """Share of an answer's statements that its context supports."""
    return statements.groupBy("query_id").agg(
        F.avg(F.col("verdict").cast("double")).alias("faithfulness")
    )


def response_relevancy(regenerated: DataFrame) -> DataFrame:
    """Mean similarity of a question and the questions regenerated from its answer."""
    return regenerated.groupBy("query_id").agg(
        F.avg(
            cosine_similarity(F.col("query_vector"), F.col("regenerated_vector"))
        ).alias("response_relevancy")
    )


def context_precision(contexts: DataFrame) -> DataFrame:
    """Precision at each relevant rank, averaged; 0 when nothing is relevant.

    ``contexts`` has one row per retrieved chunk, at most top-k per query.
    """
    so_far = Window.partitionBy("query_id").orderBy("rank")
    at_rank = contexts.withColumn(
        "precision",
        F.sum("verdict").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) / F.col("rank"),
    )
    return at_rank.groupBy("query_id").agg(
        F.coalesce(
            F.sum(F.col("precision") * F.col("verdict")) / F.nullif(F.sum("verdict"), F.lit(0)),
            F.lit(0.0),
        ).alias("context_precision")
    )


def evaluate_scores(
    statements: DataFrame, regenerated: DataFrame, contexts: DataFrame
) -> DataFrame:
    return (
        faithfulness(statements)
        .join(response_relevancy(regenerated), "query_id", "full")
        .join(context_precision(contexts), "query_id", "full")
    )


def split_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that worked, without the error column, and rows that failed."""
    failed = F.col("error").isNotNull()
    return rows.where(~failed).drop("error"), rows.where(failed)
