"""Encoding of texts, with the built-in encoder or a model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexweave.functions.vectors import HASH_MODEL, HASH_VERSION, hash_embedding

BATCH_SIZE = 64

# A column expression from text to ``array<float>``.
Encoder = Callable[[Column], Column]

# Called once per Python worker; returns a function from an array of texts to a
# matrix with one row per text.
ModelLoader = Callable[[], Callable[[np.ndarray], np.ndarray]]


def model_encoder(load_model: ModelLoader, batch_size: int = BATCH_SIZE) -> Encoder:
    """An encoder that runs a model over Arrow batches of texts."""
    return predict_batch_udf(
        load_model, return_type=ArrayType(FloatType()), batch_size=batch_size
    )


def embed_chunks(
    chunks: DataFrame,
    encoder: Encoder = hash_embedding,
    model: str = HASH_MODEL,
    version: str = HASH_VERSION,
    text: str = "chunk_text",
) -> DataFrame:
    return chunks.withColumns(
        {
            "embedding": encoder(F.col(text)),
            "embedding_model": F.lit(model),
            "embedding_version": F.lit(version),
        }
    )


def embed_questions(
    questions: DataFrame, encoder: Encoder = hash_embedding, text: str = "question"
) -> DataFrame:
    return questions.withColumn("query_vector", encoder(F.col(text)))


def missing_embeddings(embedded: DataFrame) -> DataFrame:
    """How many chunks came back without a vector; zero is valid."""
    return embedded.agg(
        F.count("*").alias("chunks"),
        F.count("embedding").alias("embeddings"),
        F.count_if(F.col("embedding").isNull()).alias("violations"),
    )


def wrong_dimensions(embedded: DataFrame, dimensions: int) -> DataFrame:
    """How many vectors an index of fixed width would refuse."""
    return embedded.agg(
        F.count("*").alias("vectors"),
        F.count_if(
            F.coalesce(F.size("embedding") != dimensions, F.lit(True))
        ).alias("violations"),
    )


def require_embeddings(embedded: DataFrame) -> DataFrame:
    """Strict form: the job fails on the first chunk without a vector."""
    return embedded.withColumn(
        "embedding",
        F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(
            F.raise_error(F.lit("chunk without embedding")).cast("array<float>")
        ),
    )
