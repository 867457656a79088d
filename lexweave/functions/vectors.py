"""Vector expressions and the built-in feature-hashing encoder.

Vectors are stored as ``array<float>`` and computed on as double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.chunking import let

# Scores that agree to this many decimals are ties.
SCORE_DECIMALS = 9

# The built-in encoder.
HASH_DIMENSIONS = 64
HASH_MODEL = "feature-hashing-64"
HASH_VERSION = "md5_token_counts_v1"
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def normalize_vector(vector: Column) -> Column:
    """Null becomes empty, null elements are dropped, the rest become doubles."""
    return F.coalesce(
        F.transform(F.filter(vector, lambda x: x.isNotNull()), lambda x: x.cast("double")),
        F.array().cast("array<double>"),
    )


def normalize_nested_vector(vector: Column) -> Column:
    """As ``normalize_vector`` for nested elements: each counts as its last item."""
    filled = F.filter(vector, lambda x: F.size(x) > 0)
    return normalize_vector(F.transform(filled, lambda x: F.element_at(x, -1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _cosine_of_equal_lengths(a: Column, b: Column) -> Column:
    return let(
        norm(a) * norm(b),
        lambda scale: F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0)),
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 when either vector is empty or zero."""

    def compare(x: Column, y: Column) -> Column:
        return F.when(
            F.size(x) == F.size(y), _cosine_of_equal_lengths(x, y)
        ).otherwise(
            let(
                F.least(F.size(x), F.size(y)),
                lambda n: let(
                    F.slice(x, F.lit(1), n),
                    lambda xs: let(
                        F.slice(y, F.lit(1), n), lambda ys: _cosine_of_equal_lengths(xs, ys)
                    ),
                ),
            )
        )

    return let(
        normalize_vector(a), lambda x: let(normalize_vector(b), lambda y: compare(x, y))
    )


def cosine_distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def rounded_score(similarity: Column) -> Column:
    return F.round(similarity, SCORE_DECIMALS)


def hash_embedding(text: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """Token counts per hash bucket, scaled to unit length, as ``array<float>``."""
    buckets = F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0)),
        lambda token: (
            F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")
            % dimensions
        ),
    )
    counts = let(
        buckets,
        lambda bs: F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(dimensions - 1).cast("bigint")),
            lambda d: (F.size(bs) - F.size(F.array_remove(bs, d))).cast("double"),
        ),
    )
    return let(
        counts,
        lambda cs: let(
            norm(cs),
            lambda length: F.transform(
                cs,
                lambda c: F.when(length > 0, c / length).otherwise(F.lit(0.0)).cast("float"),
            ),
        ),
    )
