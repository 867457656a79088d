"""Sources, sinks, simple projections, joins and counts over documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.catalog import inputs, sql
from lexweave.catalog.registry import query
from lexweave.functions.text import first_non_empty, first_non_zero, preview
from lexweave.functions.vectors import HASH_MODEL, HASH_VERSION
from lexweave.operators import documents as docs
from lexweave.operators import enrich, report, search
from lexweave.operators.embed import embed_chunks, missing_embeddings, wrong_dimensions
from lexweave.plans import library, rag
from lexweave.sinks import files as file_sinks
from lexweave.sinks import tables as table_sinks
from lexweave.sinks.versions import Manifest, Versions, empty_table
from lexweave.sources import files, tables
from lexweave.storage import materialize, new_dir

_LEGAL = sql.with_(sql.LEGAL)
_BRONZE = sql.with_(sql.LEGAL, sql.BRONZE)
_CHUNKS = sql.LEGAL_CHUNKS


# -- sources -----------------------------------------------------------------


@query("bronze_documents", _BRONZE + "SELECT * FROM bronze")
def bronze_documents(spark, sf_dir):
    return files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT)


@query(
    "extract_pages",
    _LEGAL
    + """SELECT document_id, file_name, CAST(i AS INTEGER) AS page_number,
      ps[i] AS page_text, length(ps[i])::INTEGER AS char_count, 'text' AS extraction_method
    FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT document_id, file_name, string_split(replace(full_text, e'\nArticle ',
        chr(12) || 'Article '), chr(12)) AS ps FROM legal_documents))""",
)
def extract_pages(spark, sf_dir):
    """Text documents whose articles start new pages."""
    texts = docs.document_text(inputs.legal_pages(spark, sf_dir)).withColumn(
        "full_text", F.replace("full_text", F.lit("\nArticle "), F.lit("\fArticle "))
    )
    return files.text_pages(texts)


@query("table_scan", _BRONZE + "SELECT * FROM bronze")
def table_scan(spark, sf_dir):
    target = inputs.scratch_target(spark)
    rows = files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT)
    table_sinks.overwrite_table(rows, target, "bronze_raw_documents")
    return tables.table_scan(spark, target, "bronze_raw_documents")


_JSON_ROWS = (
    "document_id, chunk_uid, chunk_id, chunk_type, article_number, annex_number, title, "
    "part_index, part_count, page_number, chunk_text, char_length, law_passed_date, "
    "regulation_title, document_version, issuing_authority"
)


def _chunk_json(spark, sf_dir):
    pages = inputs.legal_pages(spark, sf_dir)
    headers = enrich.first_page_metadata(pages).withColumnRenamed("file_name", "source_pdf")
    law_date = F.to_date(enrich.lookup(F.col("document_id"), enrich.LAW_PASSED_DATES))
    return file_sinks.chunk_documents_json(docs.silver_chunks(pages), headers, law_date)


_CHUNK_JSON_SQL = (
    _CHUNKS
    + f"""SELECT {_JSON_ROWS.replace("law_passed_date", "coalesce(meta.law_passed_date, "
      "silver.law_passed_date) AS law_passed_date")}
    FROM silver JOIN meta USING (document_id)"""
)


@query("chunk_json_source", _CHUNK_JSON_SQL)
def chunk_json_source(spark, sf_dir):
    path = new_dir(spark, "chunk-json")
    file_sinks.write_chunk_json(_chunk_json(spark, sf_dir), path)
    return tables.chunk_json_source(spark, path).select(*_JSON_ROWS.split(", "))


@query(
    "golden_dataset_source",
    """SELECT concat('Act ', conv_id, '-', turn // 2) AS act,
      max(CASE WHEN turn % 2 = 0 THEN text END) AS question,
      max(CASE WHEN turn % 2 = 1 THEN text END) AS ground_truth
    FROM conversations GROUP BY conv_id, turn // 2""",
)
def golden_dataset_source(spark, sf_dir):
    """Every two turns of a conversation as a question and its expected answer."""
    path = new_dir(spark, "golden-json")
    asks = F.col("turn") % 2 == 0
    (
        inputs.table(spark, sf_dir, "conversations")
        .groupBy("conv_id", F.expr("turn div 2").alias("pair"))
        .agg(
            F.max(F.when(asks, F.col("text"))).alias("question"),
            F.max(F.when(~asks, F.col("text"))).alias("ground_truth"),
        )
        .select(
            F.concat(F.lit("Act "), F.concat_ws("-", "conv_id", "pair")).alias("act"),
            "question",
            "ground_truth",
        )
        .write.json(path)
    )
    return tables.golden_dataset(spark, path, multi_line=False)


@query(
    "source_manifest",
    _BRONZE
    + f"""SELECT document_id AS title,
      '{files.URL_PREFIX}' || string_split(document_id, '_')[1] AS url,
      string_split(document_id, '_')[1] AS celex_id,
      string_split(document_id, '_')[2] AS language FROM bronze""",
)
def source_manifest(spark, sf_dir):
    rows = files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT)
    return files.source_manifest(rows)


_REGISTRY_SQL = (
    _CHUNKS
    + """SELECT document_id, file_name AS source_pdf, regulation_title, document_version,
      issuing_authority, meta.law_passed_date, count(chunk_id) AS chunk_count
    FROM bronze JOIN meta USING (document_id) LEFT JOIN chunks USING (document_id, file_name)
    GROUP BY ALL"""
)


def _registry(spark, sf_dir):
    pages = inputs.legal_pages(spark, sf_dir)
    return rag.registry_rows(pages, docs.chunk_documents(docs.document_text(pages)))


@query("registry_source", _REGISTRY_SQL)
def registry_source(spark, sf_dir):
    path = new_dir(spark, "registry")
    schemas.conform(_registry(spark, sf_dir), schemas.REGISTRY, strict=True).write.parquet(path)
    return tables.registry(spark, path).drop("ingested_at")


# -- sinks -------------------------------------------------------------------


@query(
    "overwrite_table",
    _LEGAL + "SELECT document_id, file_name, page_number, page_text FROM legal_pages",
)
def overwrite_table(spark, sf_dir):
    """A table replaced by one with other columns."""
    target = inputs.scratch_target(spark)
    pages = inputs.legal_pages(spark, sf_dir)
    table_sinks.overwrite_table(pages.select("document_id", "char_count"), target, "pages")
    table_sinks.overwrite_table(
        pages.select("document_id", "file_name", "page_number", "page_text"), target, "pages"
    )
    return tables.table_scan(spark, target, "pages")


_GOLD_COLUMNS = (
    "chunk_uid, document_id, file_name, chunk_id, page_number, chunk_type, article_number, "
    "annex_number, title, part_index, part_count, chunk_text, char_length, law_passed_date, "
    "source_path, source_name, regulation_family"
)
_GOLD_SQL = _CHUNKS + f"SELECT {_GOLD_COLUMNS} FROM gold"


def _gold(spark, sf_dir):
    pages = inputs.legal_pages(spark, sf_dir)
    rows = files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT)
    return enrich.gold_chunks(docs.silver_chunks(pages), rows)


@query("gold_ctas", _GOLD_SQL)
def gold_ctas(spark, sf_dir):
    target = inputs.scratch_target(spark)
    table_sinks.overwrite_table(_gold(spark, sf_dir), target, "gold_ai_ready_chunks")
    return tables.table_scan(spark, target, "gold_ai_ready_chunks")


@query(
    "vector_upsert",
    _CHUNKS
    + f"""SELECT chunk_uid, source_file, page_number, chunk_index, type, article_number,
      annex_number, title, part_index, part_count, law_passed_date, regulation_title,
      document_version, issuing_authority, '' AS ingested_at, text,
      {sql.vector_facts()}
    FROM (
      SELECT *, {sql.embedding("text")} AS embedding,
        row_number() OVER (PARTITION BY chunk_uid ORDER BY chunk_index DESC) AS rn
      FROM (SELECT chunk_uid, file_name AS source_file, coalesce(page_number, -1) AS page_number,
          chunk_id AS chunk_index, chunk_type AS type,
          coalesce(article_number, '') AS article_number,
          coalesce(annex_number, '') AS annex_number, coalesce(title, '') AS title,
          part_index, part_count,
          coalesce(CAST(law_passed_date AS VARCHAR), '') AS law_passed_date,
          coalesce(regulation_title, '') AS regulation_title,
          coalesce(document_version, '') AS document_version,
          coalesce(issuing_authority, '') AS issuing_authority, chunk_text AS text
        FROM rag_chunks))
    WHERE rn = 1""",
)
def vector_upsert(spark, sf_dir):
    """An index that holds every chunk with an outdated text takes them all again."""
    chunks = rag.ingest(inputs.legal_pages(spark, sf_dir))
    rows = embed_chunks(
        search.encode_nulls(chunks, "chunk_text")
    ).drop("embedding_model", "embedding_version")
    incoming = materialize(rows.withColumnRenamed("chunk_text", "text"), "incoming-rows")
    outdated = incoming.withColumn("text", F.lit("outdated")).withColumn("title", F.lit("?"))
    store = Versions(spark, new_dir(spark, "versions"))
    table = empty_table(incoming.schema, ["chunk_uid"], buckets=16)
    manifest = Manifest()
    for generation, rows in (("outdated", outdated), ("current", incoming)):
        last = table_sinks.last_rows(rows, "chunk_uid", F.col("chunk_index"))
        table = store.replaced(table, generation, last)
        manifest = store.commit(replace(manifest, tables={"index": table}))
    stored = store.read("index")
    return stored.select(
        *[c for c in stored.columns if c != "embedding"], *inputs.vector_facts()
    )


@query(
    "chunk_json_sink",
    _CHUNKS
    + """SELECT document_id, concat(document_id, '.pdf') AS source_pdf, regulation_title,
      document_version, issuing_authority,
      coalesce(meta.law_passed_date, max(silver.law_passed_date)) AS law_passed_date,
      (sum(count(*)) OVER (PARTITION BY document_id))::INTEGER AS chunk_count,
      (chunk_id // 10000)::INTEGER AS piece,
      string_agg(chunk_uid, ',' ORDER BY chunk_id) AS uids, sum(char_length) AS chars
    FROM silver JOIN meta USING (document_id)
    GROUP BY document_id, regulation_title, document_version, issuing_authority,
      meta.law_passed_date, chunk_id // 10000""",
)
def chunk_json_sink(spark, sf_dir):
    path = new_dir(spark, "chunk-json")
    file_sinks.write_chunk_json(_chunk_json(spark, sf_dir), path)
    return spark.read.schema(schemas.CHUNK_DOCUMENT).json(path).select(
        "document_id",
        "source_pdf",
        "regulation_title",
        "document_version",
        "issuing_authority",
        "law_passed_date",
        "chunk_count",
        "piece",
        F.array_join("chunks.chunk_uid", ",").alias("uids"),
        F.aggregate("chunks.char_length", F.lit(0).cast("bigint"), lambda a, n: a + n).alias(
            "chars"
        ),
    )


@query(
    "extracted_text_sink",
    _LEGAL
    + """SELECT document_id, md5(full_text) AS text_md5, length(full_text)::INTEGER AS chars
    FROM legal_documents""",
)
def extracted_text_sink(spark, sf_dir):
    path = new_dir(spark, "text")
    file_sinks.write_document_text(inputs.legal_pages(spark, sf_dir), path)
    return file_sinks.read_document_text(spark, path).select(
        "document_id",
        F.md5(F.col("full_text").cast("binary")).alias("text_md5"),
        F.length("full_text").alias("chars"),
    )


@query(
    "embeddings_json_sink",
    _CHUNKS
    + f"""SELECT document_id, chunk_uid, chunk_id, {sql.vector_facts()}
    FROM (SELECT *, {sql.embedding("chunk_text")} AS embedding FROM chunks)""",
)
def embeddings_json_sink(spark, sf_dir):
    path = new_dir(spark, "embeddings-json")
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    embedded = embed_chunks(chunks)
    file_sinks.write_embeddings_json(embedded, path)
    return (
        spark.read.schema(embedded.schema)
        .json(path)
        .select("document_id", "chunk_uid", "chunk_id", *inputs.vector_facts())
    )


@query("registry_append", _REGISTRY_SQL)
def registry_append(spark, sf_dir):
    """Two appends, of the documents with an even number of chunks and of the others."""
    path = new_dir(spark, "registry")
    rows = _registry(spark, sf_dir)
    regular = F.col("chunk_count") % 2 == 0
    file_sinks.append_registry(rows.where(regular), path)
    file_sinks.append_registry(rows.where(~regular), path)
    return tables.registry(spark, path).drop("ingested_at")


# -- projections, filters, checks --------------------------------------------


@query(
    "typed_chunks",
    """SELECT conv_id::INTEGER AS chunk_id, TRY_CAST(TRY_CAST(role AS DOUBLE) AS INTEGER)
        AS page_number,
      turn::INTEGER AS part_index, length(text)::INTEGER AS char_length,
      CAST(CASE WHEN turn = 0 THEN make_date(2016, 1, 1) + (conv_id % 300)::INTEGER END AS DATE)
        AS law_passed_date,
      CAST(make_date(2020, 1, 1) + (conv_id % 300)::INTEGER AS TIMESTAMP) AS ingested_at
    FROM conversations""",
)
def typed_chunks(spark, sf_dir):
    """Text columns cast to the declared types; what cannot be cast is null."""
    raw = inputs.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("chunk_id"),
        F.col("role").alias("page_number"),
        F.col("turn").cast("string").alias("part_index"),
        F.length("text").cast("string").alias("char_length"),
        F.when(
            F.col("turn") == 0,
            F.date_add(F.lit("2016-01-01"), (F.col("conv_id") % 300).cast("int")),
        )
        .otherwise(None)
        .cast("string")
        .alias("law_passed_date"),
        F.date_add(F.lit("2020-01-01"), (F.col("conv_id") % 300).cast("int"))
        .cast("string")
        .alias("ingested_at"),
    )
    typed = schemas.conform(raw, schemas.TABLES["silver_chunks"])
    return typed.select(
        *raw.columns[:-1], F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at")
    )


@query(
    "index_projection",
    _CHUNKS
    + f"""SELECT chunk_uid, document_id, file_name, chunk_id, page_number, article_number,
      title, chunk_text, char_length, regulation_family, source_name, source_path,
      {sql.vector_facts()}
    FROM (SELECT *, {sql.embedding("chunk_text")} AS embedding FROM gold)""",
)
def index_projection(spark, sf_dir):
    read = search.index_projection(embed_chunks(_gold(spark, sf_dir)))
    return read.select(
        *[c for c in read.columns if c != "embedding"], *inputs.vector_facts()
    )


@query(
    "null_encoding",
    _CHUNKS
    + """SELECT chunk_uid, file_name AS source_file, coalesce(page_number, -1) AS page_number,
      chunk_id AS chunk_index, chunk_type AS type,
      coalesce(article_number, '') AS article_number, coalesce(annex_number, '') AS annex_number,
      coalesce(title, '') AS title, part_index, part_count,
      coalesce(CAST(law_passed_date AS VARCHAR), '') AS law_passed_date,
      CASE WHEN chunk_id % 2 = 0 THEN '2024-01-02 03:04:05' ELSE '' END AS ingested_at,
      coalesce(regulation_title, '') AS regulation_title,
      coalesce(document_version, '') AS document_version,
      coalesce(issuing_authority, '') AS issuing_authority
    FROM rag_chunks""",
)
def null_encoding(spark, sf_dir):
    """All chunks, every other one with a time of intake."""
    at = F.when(F.col("chunk_id") % 2 == 0, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    chunks = rag.ingest(inputs.legal_pages(spark, sf_dir))
    return search.encode_nulls(chunks.withColumn("ingested_at", at))


@query(
    "first_non_empty",
    """SELECT conv_id, turn,
      coalesce(nullif(CASE WHEN turn % 3 = 0 THEN '' ELSE text END, ''), nullif(
        CASE WHEN turn % 2 = 0 THEN role END, ''), '') AS first_text,
      coalesce(nullif(turn % 3, 0), nullif(conv_id % 2, 0)) AS first_page
    FROM conversations""",
)
def first_non_empty_of(spark, sf_dir):
    turn = F.col("turn")
    return inputs.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        first_non_empty(
            F.when(turn % 3 == 0, F.lit("")).otherwise(F.col("text")),
            F.when(turn % 2 == 0, F.col("role")),
        ).alias("first_text"),
        first_non_zero(turn % 3, F.col("conv_id") % 2).alias("first_page"),
    )


@query(
    "text_preview",
    """SELECT doc_id, substr(text, 1, 1200) AS source_text, substr(text, 1, 120) AS shown_120,
      substr(text, 1, 100) AS shown_100, substr(text, 1, 80) AS shown_80 FROM documents""",
)
def text_preview(spark, sf_dir):
    text = F.col("text")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        preview(text, 1200).alias("source_text"),
        preview(text, 120).alias("shown_120"),
        preview(text, 100).alias("shown_100"),
        preview(text, 80).alias("shown_80"),
    )


@query(
    "orphan_chunks",
    _CHUNKS
    + """SELECT document_id, chunk_id, chunk_type, article_number FROM silver
    WHERE page_number IS NULL""",
)
def orphan_chunks(spark, sf_dir):
    chunks = docs.silver_chunks(inputs.legal_pages(spark, sf_dir))
    return docs.orphan_chunks(chunks).select(
        "document_id", "chunk_id", "chunk_type", "article_number"
    )


@query(
    "limit_chunks",
    _CHUNKS + "SELECT document_id, chunk_id, chunk_uid, chunk_text FROM chunks WHERE chunk_id < 1",
)
def limit_chunks(spark, sf_dir):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return docs.limit_chunks(chunks).select("document_id", "chunk_id", "chunk_uid", "chunk_text")


_SOME_MISSING = "CASE WHEN vec_id % 7 <> 3 THEN embedding END"


@query(
    "validate_embeddings",
    f"""SELECT count(*) AS chunks, count(e) AS embeddings,
      count(*) FILTER (e IS NULL) AS violations
    FROM (SELECT {_SOME_MISSING} AS e FROM embeddings)""",
)
def validate_embeddings(spark, sf_dir):
    """A table in which every seventh vector is missing."""
    return missing_embeddings(
        inputs.vectors(spark, sf_dir).selectExpr(f"{_SOME_MISSING} AS embedding")
    )


@query(
    "validate_dims",
    """SELECT count(*) AS vectors, count(*) FILTER (coalesce(len(e) <> 64, true)) AS violations
    FROM (SELECT CASE label WHEN 0 THEN embedding[1:63] WHEN 1 THEN NULL ELSE embedding END AS e
          FROM embeddings)""",
)
def validate_dims(spark, sf_dir):
    """A table in which one label's vectors are short and another's are missing."""
    return wrong_dimensions(
        inputs.vectors(spark, sf_dir).selectExpr(
            "CASE label WHEN 0 THEN slice(embedding, 1, 63) WHEN 1 THEN NULL "
            "ELSE embedding END AS embedding"
        ),
        inputs.VECTOR_DIMENSIONS,
    )


@query(
    "dimension_lookup",
    _BRONZE
    + f"""SELECT document_id, regulation_family,
      CAST({sql.constant("document_id", enrich.LAW_PASSED_DATES)} AS DATE) AS law_passed_date
    FROM bronze""",
)
def dimension_lookup(spark, sf_dir):
    document_id = files.stem(F.col("file_name"))
    return inputs.legal_files(spark, sf_dir).select(
        document_id.alias("document_id"),
        enrich.lookup(document_id, enrich.REGULATION_FAMILIES).alias("regulation_family"),
        F.to_date(enrich.lookup(document_id, enrich.LAW_PASSED_DATES)).alias("law_passed_date"),
    )


@query(
    "index_stats_sample",
    _CHUNKS
    + """SELECT (SELECT count(*) FROM chunks) AS row_count,
      'chunk_uid,document_id,file_name,chunk_id,chunk_type,article_number,annex_number,title,'
      || 'part_index,part_count,chunk_text,char_length,embedding,embedding_model,'
      || 'embedding_version' AS field_names,
      substr(chunk_uid, 1, 100) AS sample_chunk_uid,
      substr(chunk_text, 1, 100) AS sample_chunk_text,
      CAST(char_length AS VARCHAR) AS sample_char_length
    FROM chunks ORDER BY chunk_uid, chunk_id LIMIT 1""",
)
def index_stats_sample(spark, sf_dir):
    chunks = docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    return report.index_stats(embed_chunks(chunks)).select(
        "row_count", "field_names", "sample_chunk_uid", "sample_chunk_text", "sample_char_length"
    )


# -- joins -------------------------------------------------------------------


@query("gold_chunks", _GOLD_SQL)
def gold_chunks(spark, sf_dir):
    return _gold(spark, sf_dir)


@query(
    "tag_pages",
    _CHUNKS
    + "SELECT document_id, chunk_id, chunk_uid, page_number FROM silver",
)
def tag_pages(spark, sf_dir):
    """The form for documents of any length, over chunk and page rows."""
    pages = inputs.legal_pages(spark, sf_dir)
    chunks = docs.chunk_documents(docs.document_text(pages))
    return docs.tag_pages(chunks, pages).select(
        "document_id", "chunk_id", "chunk_uid", "page_number"
    )


@query(
    "pair_embeddings",
    _CHUNKS
    + f"""SELECT document_id, chunk_id, chunk_uid, {sql.vector_facts()},
      '{HASH_MODEL}' AS embedding_model, '{HASH_VERSION}' AS embedding_version
    FROM (SELECT *, {sql.embedding("chunk_text")} AS embedding FROM chunks)""",
)
def pair_embeddings(spark, sf_dir):
    """Vectors stored apart from their chunks, paired by chunk key."""
    chunks = materialize(
        docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir)), "chunks"
    )
    stored = embed_chunks(chunks).select(
        "document_id", "chunk_id", "embedding", "embedding_model", "embedding_version"
    )
    return chunks.join(stored, ["document_id", "chunk_id"]).select(
        "document_id",
        "chunk_id",
        "chunk_uid",
        *inputs.vector_facts(),
        "embedding_model",
        "embedding_version",
    )


_FIRST_CLASS = "length(document_id) % 3"


@query(
    "incremental_intake",
    sql.LEGAL_CHUNKS
    + f"""SELECT concat(document_id, '.pdf') AS source_pdf,
      CASE WHEN bad OR class = 0 THEN 'new' WHEN class = 1 THEN 'changed' ELSE 'same' END
        AS status,
      CASE WHEN bad THEN NULL ELSE coalesce(n, 0) END AS chunk_count,
      CASE WHEN bad THEN 0 ELSE coalesce(labels, 0) END AS indexed
    FROM (SELECT document_id, contains(full_text, 'Clause ') AS bad,
            {_FIRST_CLASS} AS class FROM legal_documents)
    LEFT JOIN (SELECT document_id, count(*) AS n, count(DISTINCT chunk_uid) AS labels
               FROM chunks GROUP BY document_id) USING (document_id)
    UNION ALL SELECT concat('gone-', document_id, '.pdf'), 'gone', NULL, 0
    FROM legal_documents WHERE {_FIRST_CLASS} = 0 AND NOT contains(full_text, 'Clause ')""",
)
def incremental_intake(spark, sf_dir):
    """A library that was brought up to an earlier listing is brought up to all files.

    Of the files, a third was missing then and had another name, and a third had more text.
    """
    listed = materialize(inputs.legal_file_contents(spark, sf_dir), "files")
    group = (F.length("path") - 4) % 3
    more = F.concat("content", F.lit("\fMore text.\n").cast("binary"))
    earlier = listed.select(
        F.when(group == 0, F.concat(F.lit("gone-"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(group == 1, more).otherwise(F.col("content")).alias("content"),
    )
    store = library.Library(new_dir(spark, "library"), buckets=8)
    library.sync(earlier, store, "first", inputs.form_feed_pages, "stand-in")
    found, _ = library.sync(listed, store, "second", inputs.form_feed_pages, "stand-in")
    indexed = (
        store.read(spark, library.INDEX)
        .groupBy(F.col("file_name").alias("source_pdf"))
        .agg(F.count("*").alias("indexed"))
    )
    registry = store.read(spark, library.REGISTRY).select("source_pdf", "chunk_count")
    return (
        found.join(registry, "source_pdf", "left")
        .join(indexed, "source_pdf", "left")
        .select(
            "source_pdf",
            "status",
            "chunk_count",
            F.coalesce("indexed", F.lit(0).cast("bigint")).alias("indexed"),
        )
    )


@query(
    "skip_known_sources",
    """SELECT doc_id, source, n_chars FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
)
def skip_known_sources(spark, sf_dir):
    """Documents that the registry of labelled ones does not hold yet."""
    candidates = inputs.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return enrich.skip_known(candidates, inputs.table(spark, sf_dir, "labels"), "doc_id")


# -- counts ------------------------------------------------------------------


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for t in ("documents", "embeddings", "conversations", "benchmark", "labels")
    ),
)
def table_counts(spark, sf_dir):
    names = ("documents", "embeddings", "conversations", "benchmark", "labels")
    return report.table_counts({n: inputs.table(spark, sf_dir, n) for n in names})


@query(
    "document_text",
    _LEGAL + "SELECT document_id, file_name, full_text FROM legal_documents",
)
def document_text(spark, sf_dir):
    return docs.document_text(inputs.legal_pages(spark, sf_dir))


@query(
    "chunk_counts",
    _CHUNKS + "SELECT document_id, count(*) AS chunk_count FROM chunks GROUP BY document_id",
)
def chunk_counts(spark, sf_dir):
    return report.chunk_counts(
        docs.chunk_documents(inputs.legal_texts_of_pages(spark, sf_dir))
    )


@query(
    "ingestion_summary",
    _CHUNKS
    + """SELECT document_id, coalesce(chunks, 0) AS chunks, coalesce(skipped, 0) AS skipped,
      chars, pages
    FROM (SELECT document_id, CAST(sum(length(page_text)) + count(*) - 1 AS BIGINT) AS chars,
            count(*) AS pages FROM legal_pages GROUP BY document_id)
    LEFT JOIN (SELECT document_id, count(*) AS chunks,
                 count(*) FILTER (page_number IS NULL) AS skipped
               FROM silver GROUP BY document_id) USING (document_id)""",
)
def ingestion_summary(spark, sf_dir):
    pages = inputs.legal_pages(spark, sf_dir)
    return report.ingestion_summary(docs.silver_chunks(pages), pages)


@query(
    "facet_counts",
    _CHUNKS
    + " UNION ALL ".join(
        f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value, count(*) AS row_count "
        f"FROM rag_chunks GROUP BY {f}"
        for f in ("file_name", "regulation_title", "chunk_type")
    ),
)
def facet_counts(spark, sf_dir):
    return report.facet_counts(
        rag.ingest(inputs.legal_pages(spark, sf_dir)),
        ["file_name", "regulation_title", "chunk_type"],
    )


@query(
    "page_numbering",
    _LEGAL
    + """SELECT document_id, file_name, page_number, char_count, extraction_method
    FROM legal_pages""",
)
def page_numbering(spark, sf_dir):
    return inputs.legal_pages(spark, sf_dir).drop("page_text")


@query(
    "ordered_scan",
    _LEGAL
    + """SELECT document_id, page_number, md5(page_text) AS text_md5 FROM legal_pages
    ORDER BY document_id, page_number""",
)
def ordered_scan(spark, sf_dir):
    pages = inputs.legal_pages(spark, sf_dir).select(
        "document_id", "page_number", F.md5(F.col("page_text").cast("binary")).alias("text_md5")
    )
    return docs.ordered_scan(pages, ("document_id", "page_number"))


@query(
    "run_log",
    _CHUNKS
    + """SELECT * FROM (
      SELECT 'bronze' AS step_name, 'ok' AS status, (SELECT count(*) FROM bronze) AS row_count,
        '' AS message
      UNION ALL SELECT 'pages', 'ok', (SELECT count(*) FROM legal_pages), ''
      UNION ALL SELECT 'chunks', 'ok', (SELECT count(*) FROM chunks), ''
      UNION ALL SELECT 'gold', 'ok', (SELECT count(*) FROM gold), ''
      UNION ALL SELECT 'embeddings', 'ok', (SELECT count(*) FROM gold), '')""",
)
def run_log(spark, sf_dir):
    from lexweave.plans import medallion

    target = inputs.scratch_target(spark)
    medallion.build(
        spark,
        target,
        files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT),
        inputs.legal_pages(spark, sf_dir),
    )
    return tables.table_scan(spark, target, "pipeline_run_log").drop("logged_at")
