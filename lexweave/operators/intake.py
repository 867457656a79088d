"""What a source holds against what was taken in before, by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, GONE, SAME = "new", "changed", "gone", "same"


def content_digest(content: Column) -> Column:
    """SHA-256 of a text or of bytes; null counts as empty."""
    return F.sha2(F.coalesce(content.cast("binary"), F.lit("").cast("binary")), 256)


def changes(listing: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key of either side once, with its ``status``: only listed (``new``), listed with
    another digest than the known one (``changed``), only known (``gone``) or ``same``.

    Both sides have one row per key; a known row without a digest counts as changed.
    """
    old = known.select(F.col(key), F.col(digest).alias("_known"), F.lit(True).alias("_old"))
    now = listing.select(F.col(key), F.col(digest), F.lit(True).alias("_listed"))
    status = (
        F.when(F.col("_old").isNull(), NEW)
        .when(F.col("_listed").isNull(), GONE)
        .when(F.col(digest).eqNullSafe(F.col("_known")) & F.col(digest).isNotNull(), SAME)
        .otherwise(CHANGED)
    )
    return now.join(old, key, "full").select(key, digest, status.alias("status"))
