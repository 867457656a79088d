"""Text and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.catalog import inputs, sql
from lexweave.catalog.registry import query
from lexweave.functions import chunking, text
from lexweave.functions.vectors import hash_embedding
from lexweave.operators import documents as docs
from lexweave.operators import enrich
from lexweave.operators.embed import embed_chunks, model_encoder
from lexweave.operators.rows import each, spread

_CHUNKS = sql.LEGAL_CHUNKS
_TEXTS = sql.with_(sql.LEGAL)


# All texts: the documents table, and the legal documents with their headers.
def _all_texts(spark, sf_dir):
    return inputs.plain_documents(spark, sf_dir).unionByName(
        inputs.legal_texts_of_pages(spark, sf_dir)
    )


_ALL = sql.with_(
    sql.LEGAL,
    sql.PLAIN,
    "texts AS (SELECT * FROM plain_documents UNION ALL SELECT * FROM legal_documents)",
)


@query(
    "clean_text",
    _ALL
    + f"SELECT document_id, {sql.clean('full_text')} AS cleaned FROM texts",
)
def clean_text(spark, sf_dir):
    return _all_texts(spark, sf_dir).select(
        "document_id", text.clean_text(F.col("full_text")).alias("cleaned")
    )


@query(
    "normalize_ws",
    _ALL
    + f"""SELECT document_id, {sql.squeeze('full_text')} AS single_spaced,
      lower({sql.squeeze('full_text')}) AS match_form FROM texts""",
)
def normalize_ws(spark, sf_dir):
    return _all_texts(spark, sf_dir).select(
        "document_id",
        text.normalize_ws(F.col("full_text")).alias("single_spaced"),
        text.match_form(F.col("full_text")).alias("match_form"),
    )


@query("split_body_annex", _CHUNKS + "SELECT document_id, body, annex FROM structured")
def split_body_annex(spark, sf_dir):
    return (
        inputs.legal_texts_of_pages(spark, sf_dir)
        .select(
            "document_id",
            chunking.split_body_annex(text.clean_text(F.col("full_text"))).alias("halves"),
        )
        .select("document_id", "halves.body", "halves.annex")
    )


def _articles(spark, sf_dir):
    articles = chunking.let(
        chunking.split_body_annex(text.clean_text(F.col("full_text"))),
        lambda halves: chunking.articles_of(halves["body"]),
    )
    texts = inputs.legal_texts_of_pages(spark, sf_dir)
    return each(texts, ["document_id"], articles, "at", "a").select(
        "document_id", (F.col("at") + 1).alias("article_index"), "a.*"
    )


@query(
    "article_segments",
    _CHUNKS
    + """SELECT document_id, article_index::INTEGER AS article_index,
      article_number AS number, article, len(parts)::INTEGER AS part_count,
      parts[1] AS first_part FROM article_parts""",
)
def article_segments(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        "document_id",
        "article_index",
        "number",
        "article",
        F.size("parts").alias("part_count"),
        F.get("parts", F.lit(0)).alias("first_part"),
    )


@query(
    "split_oversized",
    _CHUNKS
    + """SELECT document_id, article_index::INTEGER AS article_index,
      (generate_subscripts(parts, 1) - 1)::INTEGER AS part_index, unnest(parts) AS part
    FROM article_parts WHERE length(article) > 900""",
)
def split_oversized(spark, sf_dir):
    long = _articles(spark, sf_dir).where(F.length("article") > chunking.MAX_CHARS)
    return each(
        long, ["document_id", "article_index"], F.col("parts"), "part_index", "part"
    )


@query(
    "hard_split",
    f"""SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS part_index,
      unnest(parts) AS part FROM (SELECT doc_id, {sql.hard("text")} AS parts FROM documents)""",
)
def hard_split(spark, sf_dir):
    return each(
        spread(inputs.table(spark, sf_dir, "documents")),
        ["doc_id"],
        chunking.hard_split(F.col("text")),
        "part_index",
        "part",
    )


@query(
    "article_title",
    _CHUNKS
    + """SELECT document_id, article_index::INTEGER AS article_index, article_number AS number,
      title FROM titled""",
)
def article_title(spark, sf_dir):
    return _articles(spark, sf_dir).select("document_id", "article_index", "number", "title")


def _chunks_of_type(spark, sf_dir, *kinds):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return chunks.where(F.col("chunk_type").isin(*kinds))


@query(
    "annex_chunks",
    _CHUNKS
    + """SELECT document_id, annex_number, title, part_index, part_count, chunk_text
    FROM annex_rows""",
)
def annex_chunks(spark, sf_dir):
    return _chunks_of_type(spark, sf_dir, "annex").select(
        "document_id", "annex_number", "title", "part_index", "part_count", "chunk_text"
    )


@query(
    "fallback_chunks",
    sql.PLAIN_CHUNKS + "SELECT document_id, chunk_id, chunk_text FROM chunks",
)
def fallback_chunks(spark, sf_dir):
    """Fixed windows over all plain documents, which have no headings."""
    return inputs.plain_chunks(spark, sf_dir).select("document_id", "chunk_id", "chunk_text")


@query(
    "part_counts",
    _CHUNKS
    + """SELECT document_id, chunk_type, article_number, annex_number, part_index, part_count
    FROM chunks WHERE chunk_type <> 'fallback'""",
)
def part_counts(spark, sf_dir):
    return _chunks_of_type(spark, sf_dir, "article", "annex").select(
        "document_id", "chunk_type", "article_number", "annex_number", "part_index", "part_count"
    )


@query(
    "chunk_numbering",
    _CHUNKS + "SELECT document_id, chunk_id, chunk_type, part_index FROM chunks",
)
def chunk_numbering(spark, sf_dir):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return chunks.select("document_id", "chunk_id", "chunk_type", "part_index")


@query(
    "chunk_union",
    _CHUNKS
    + """SELECT document_id, count(*) FILTER (chunk_type <> 'annex') AS body_chunks,
      count(*) FILTER (chunk_type = 'annex') AS annex_chunks,
      max(chunk_id) FILTER (chunk_type <> 'annex') AS last_body_id,
      min(chunk_id) FILTER (chunk_type = 'annex') AS first_annex_id
    FROM chunks GROUP BY document_id""",
)
def chunk_union(spark, sf_dir):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    annex = F.col("chunk_type") == "annex"
    return chunks.groupBy("document_id").agg(
        F.count_if(~annex).alias("body_chunks"),
        F.count_if(annex).alias("annex_chunks"),
        F.max(F.when(~annex, F.col("chunk_id"))).alias("last_body_id"),
        F.min(F.when(annex, F.col("chunk_id"))).alias("first_annex_id"),
    )


@query("silver_chunks_of_long_documents", _CHUNKS + "SELECT * FROM silver")
def silver_chunks_of_long_documents(spark, sf_dir):
    """All documents handled in blocks, as if none would fit in a row."""
    return docs.silver_chunks(inputs.legal_pages(spark, sf_dir), in_row_chars=0)


@query("silver_chunks", _CHUNKS + "SELECT * FROM silver")
def silver_chunks(spark, sf_dir):
    return docs.silver_chunks(inputs.legal_pages(spark, sf_dir))


@query(
    "chunk_fingerprint",
    _CHUNKS + "SELECT document_id, chunk_id, mark FROM marked",
)
def chunk_fingerprint(spark, sf_dir):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return chunks.select(
        "document_id",
        "chunk_id",
        chunking.fingerprint(
            F.col("chunk_text"),
            F.col("chunk_type"),
            F.col("article_number"),
            F.col("annex_number"),
            F.col("part_index"),
        ).alias("mark"),
    )


@query("chunk_uid", _CHUNKS + "SELECT document_id, chunk_id, chunk_uid FROM chunks")
def chunk_uid(spark, sf_dir):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return chunks.select("document_id", "chunk_id", "chunk_uid")


@query("document_metadata", _CHUNKS + "SELECT * FROM meta")
def document_metadata(spark, sf_dir):
    return enrich.first_page_metadata(inputs.legal_pages(spark, sf_dir)).drop("file_name")


@query(
    "parse_law_date",
    """SELECT conv_id, turn, CAST(try_strptime(concat(conv_id % 31 + 1, ' ',
        CASE turn % 4 WHEN 0 THEN 'April' WHEN 1 THEN 'may' WHEN 2 THEN 'foo'
          ELSE 'February' END, ' 20', 10 + conv_id % 13), '%d %B %Y') AS DATE) AS law_date
    FROM conversations""",
)
def parse_law_date(spark, sf_dir):
    written = F.concat(
        (F.col("conv_id") % 31 + 1).cast("string"),
        F.lit(" "),
        F.element_at(
            F.array(*[F.lit(m) for m in ("April", "may", "foo", "February")]),
            (F.col("turn") % 4 + 1).cast("int"),
        ),
        F.lit(" 20"),
        (F.col("conv_id") % 13 + 10).cast("string"),
    )
    return inputs.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.parse_law_date(written).alias("law_date")
    )


@query(
    "html_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'),
      '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;'), chr(10), '<br>') AS escaped
    FROM pages""",
)
def html_escape(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", text.html_escape(F.col("html")).alias("escaped")
    )


@query(
    "chunk_to_json",
    _CHUNKS
    + """SELECT document_id, chunk_id, chunk_uid, chunk_type, article_number, part_index,
      char_length, chunk_text FROM chunks""",
)
def chunk_to_json(spark, sf_dir):
    """Rows as JSON text and back; non-ASCII text passes unescaped."""
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    fields = ["document_id", "chunk_id", "chunk_uid", "chunk_type", "article_number"]
    fields += ["part_index", "char_length", "chunk_text"]
    rows = chunks.select(*fields)
    as_json = rows.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")
    )
    return as_json.select(F.from_json("json", rows.schema).alias("row")).select("row.*")


@query(
    "random_uid",
    _CHUNKS + "SELECT document_id, chunk_id, true AS is_uuid FROM chunks",
)
def random_uid(spark, sf_dir):
    """A random key per chunk; rows, not keys, are comparable."""
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return chunks.withColumn("uid", F.uuid()).select(
        "document_id", "chunk_id", F.col("uid").rlike("^[0-9a-f-]{36}$").alias("is_uuid")
    )


_EMBEDDED_SQL = (
    sql.PLAIN_CHUNKS
    + f"""SELECT document_id, chunk_id, {sql.vector_facts()}
    FROM (SELECT document_id, chunk_id, {sql.embedding("chunk_text")} AS embedding
          FROM chunks)"""
)


@query("embed_chunks", _EMBEDDED_SQL)
def embed_all(spark, sf_dir):
    return embed_chunks(inputs.plain_chunks(spark, sf_dir)).select(
        "document_id", "chunk_id", *inputs.vector_facts()
    )


def load_hash_model():
    """The built-in encoder as a batch model, as a stand-in for a neural one."""
    import hashlib
    import re
    from functools import lru_cache

    import numpy as np

    @lru_cache(maxsize=1 << 16)
    def bucket(token: str) -> int:
        return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % inputs.VECTOR_DIMENSIONS

    words = re.compile(r"[^\W_]+")

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), inputs.VECTOR_DIMENSIONS))
        for row, value in enumerate(texts):
            for token in words.findall(value.lower()):
                out[row, bucket(token)] += 1
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0).astype(np.float32)

    return predict


@query("embed_batches", _EMBEDDED_SQL)
def embed_batches(spark, sf_dir):
    encoder = model_encoder(load_hash_model)
    return embed_chunks(inputs.plain_chunks(spark, sf_dir), encoder, "hash", "batch").select(
        "document_id", "chunk_id", *inputs.vector_facts()
    )


@query(
    "embed_query",
    f"""SELECT query_id, {sql.vector_facts("qv")}
    FROM (SELECT item_id AS query_id, {sql.embedding("text")} AS qv FROM benchmark)""",
)
def embed_query(spark, sf_dir):
    return inputs.questions(spark, sf_dir).select(
        "query_id", hash_embedding(F.col("question")).alias("qv")
    ).select("query_id", *inputs.vector_facts("qv"))
