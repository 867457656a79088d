"""A corpus pipeline in five stages; each takes all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import exact_dedup, jaccard_join, mixing, pieces, toxicity
from lexweave.llm.tables import crc32_of_id, table
from lexweave.storage import materialize

TOXIC_FROM = 0.3
PIECES_MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    labels = table(spark, sf_dir, "labels").where(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) != 2)
    score = toxicity.toxicity_score(toxicity.train(docs, labels))
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their shingles of five words, directly or in steps, the
    one with the smallest id stays."""
    return jaccard_join.drop_near_copies(docs, size=5, numerator=80, denominator=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(docs, public_tokenizers.path(PIECES_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# The first stage learns and the fourth draws lots, which SQL cannot restate; tests hold
# every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return docs
