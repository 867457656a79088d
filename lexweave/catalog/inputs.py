"""Inputs of the registered queries, derived from the given tables.

``legal_pages`` turns conversations into regulation-shaped documents: one article
per turn, with running headers, numbered paragraphs, annexes and a title page,
cut into pages anywhere.  A conversation longer than ``TURNS_PER_DOCUMENT`` gives
several documents, so no document grows with the longest conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.citations import INSUFFICIENT
from lexweave.operators.documents import chunk_documents, document_text
from lexweave.operators.rows import each, spread
from lexweave.sources.files import with_page_facts
from lexweave.sources.tables import Target
from lexweave.storage import new_dir

TURNS_PER_DOCUMENT = 64
PAGE_CHARS = 700
VECTOR_DIMENSIONS = 64
RAW_ROOT = "/data/regulations/raw"

# Questions asked as a smoke test of retrieval.
SMOKE_QUESTIONS = (
    "What does the data act say about keeping data?",
    "Rights of the persons concerned under the sample regulation",
    "What is the title of the user?",
)

_ARTICLE = """
    concat(
      CASE WHEN turn % 3 = 2 THEN 'EN\nL 119/1\n4.5.2016\n' ELSE '' END,
      'Article ', CAST(turn + 1 AS STRING), '\nTitle of ', role, '\n',
      CASE WHEN conv_id % 2 = 0
           THEN array_join(transform(split(text, '\n'),
                  (x, i) -> concat(CAST(i + 1 AS STRING), '. ', x)), '\n')
           ELSE text END)
"""
_DOCUMENT_ID = """
    concat(
      CASE conv_id WHEN 0 THEN '32014L0065' WHEN 1 THEN '32015L2366'
                   WHEN 2 THEN '32016R0679' WHEN 3 THEN '32024L1640'
                   WHEN 4 THEN '32024R1689'
                   ELSE concat('3', CAST(conv_id AS STRING), 'R') END,
      CASE WHEN section > 0 THEN concat('-', CAST(section AS STRING)) ELSE '' END,
      '_EN')
"""
_FULL_TEXT = """
    concat(
      'REGULATION (EU) 2016/', CAST(conv_id AS STRING),
      ' OF THE EUROPEAN PARLIAMENT AND OF THE COUNCIL\nof ',
      CAST(conv_id % 31 + 1 AS STRING), ' April 2016\n(Sample Data Act)\n',
      CASE WHEN conv_id % 10 = 8 THEN replace(body, 'Article ', 'Clause ') ELSE body END,
      CASE WHEN conv_id % 4 = 0
           THEN concat('\nANNEX I\n', substring(body, 1, 1200), '\nANNEX II\nshort annex')
           ELSE '' END)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulation-shaped documents as (document_id, file_name, full_text)."""
    articles = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        f"turn div {TURNS_PER_DOCUMENT} AS section",
        "turn",
        f"{_ARTICLE} AS article",
    )
    bodies = articles.groupBy("conv_id", "section").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", "article"))),
                lambda a: a["article"],
            ),
            "\n",
        ).alias("body")
    )
    return bodies.selectExpr(
        f"{_DOCUMENT_ID} AS document_id", f"{_FULL_TEXT} AS full_text"
    ).select(
        "document_id", F.concat("document_id", F.lit(".pdf")).alias("file_name"), "full_text"
    )


def legal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.regexp_extract_all("full_text", F.lit(rf"(?s).{{1,{PAGE_CHARS}}}"), F.lit(0))
    return with_page_facts(
        each(
            legal_texts(spark, sf_dir), ["document_id", "file_name"], pages, "at", "page_text"
        ).select(
            "document_id",
            "file_name",
            (F.col("at") + 1).alias("page_number"),
            "page_text",
        ),
        "text",
    )


def legal_texts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts put together again from their pages."""
    return document_text(legal_pages(spark, sf_dir))


def legal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document file: the title pages' file names."""
    return (
        legal_pages(spark, sf_dir).where(F.col("page_number") == 1).select("file_name")
    )


def legal_file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as (path, content), the pages of a file separated by form feeds."""
    pages = F.array_sort(F.collect_list(F.struct("page_number", "page_text")))
    text = F.array_join(F.transform(pages, lambda p: p["page_text"]), "\f")
    return (
        legal_pages(spark, sf_dir)
        .groupBy(F.col("file_name").alias("path"))
        .agg(text.cast("binary").alias("content"))
    )


def form_feed_pages(content: bytes) -> list[str]:
    """A stand-in for a PDF reader; refuses files that say so."""
    text = content.decode()
    if "Clause " in text:
        raise ValueError("unreadable file")
    return text.split("\f")


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table in the shape of document texts."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return spread(table(spark, sf_dir, "documents")).select(
        name.alias("document_id"),
        F.concat(name, F.lit(".txt")).alias("file_name"),
        F.col("text").alias("full_text"),
    )


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(plain_documents(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def smoke_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(enumerate(SMOKE_QUESTIONS)), "query_id bigint, question string"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: cited pages, unpaged citations, and refusals."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS answer_id",
        f"""concat(text,
              CASE WHEN conv_id % 5 = 4 THEN ' {INSUFFICIENT}.' ELSE '' END,
              ' [Document: Act ', CAST(conv_id AS STRING), ', Article 1, page ',
              CAST(turn % 5 AS STRING), '] "quoted" & <plain>\n',
              '[Source: Excerpt #1, Page ', CAST(turn % 5 + 2 AS STRING), ', end] ',
              '[Source: Excerpt #2]') AS answer""",
    )


def retrieved_for_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranked chunks per answer; some without page or title, pages repeat."""
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .select("conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"))
        .selectExpr(
            "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS answer_id",
            "rank",
            "CASE WHEN rank = 4 AND conv_id % 3 = 0 THEN NULL "
            "ELSE CAST((turn + rank) % 3 AS INT) END AS page",
            "concat('act', CAST(conv_id AS STRING), '-', CAST(rank AS STRING), '.pdf') "
            "AS source_file",
            "CASE WHEN rank % 2 = 0 THEN NULL ELSE concat('Act ', CAST(conv_id AS STRING)) "
            "END AS regulation_title",
            "CASE WHEN conv_id % 7 = 6 THEN '' ELSE concat('Chunk ', CAST(rank AS STRING)) "
            "END AS title",
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _mean_vector():
    means = [
        F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(VECTOR_DIMENSIONS)
    ]
    return F.array(*means)


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    return (
        vectors(spark, sf_dir)
        .groupBy(F.col("label").alias("query_id"))
        .agg(_mean_vector().alias("query_vector"))
    )


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the mean of all vectors."""
    return vectors(spark, sf_dir).agg(_mean_vector().alias("query_vector"))


def scratch_target(spark: SparkSession) -> Target:
    """A schema of its own under the shared folder."""
    path = new_dir(spark, "schema")
    target = Target(path.rsplit("/", 1)[1].replace("-", "_"))
    spark.sql(f"CREATE SCHEMA {target.namespace} LOCATION '{path}'")
    return target


def vector_facts(vector: str = "embedding") -> list:
    """Flat facts that pin a vector down: size, number of non-zeros, weighted sum."""
    v = F.col(vector)
    weighted = F.aggregate(
        F.transform(v, lambda x, i: x.cast("double") * (i + 1)),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    return [
        F.size(v).alias("dims"),
        F.size(F.filter(v, lambda x: x != 0)).alias("non_zero"),
        F.round(weighted, 4).alias("weighted_sum"),
    ]


