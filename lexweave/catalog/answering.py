"""Context, answers, citations, evaluation and composite builds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.catalog import inputs, sql
from lexweave.catalog.registry import query
from lexweave.catalog.searching import RAG_HITS, rag_hits, rag_index
from lexweave.functions.citations import INSUFFICIENT
from lexweave.functions.vectors import cosine_similarity, rounded_score
from lexweave.operators import answers as ans
from lexweave.operators import context, evaluate, search
from lexweave.operators.rows import small_side
from lexweave.plans import evaluation, library, medallion, rag
from lexweave.sinks import files as file_sinks
from lexweave.sources import files, tables
from lexweave.storage import materialize, new_dir

_ANSWERS = sql.with_(sql.ANSWERS)

_HEADER = """concat('[', coalesce(nullif(regulation_title, ''), file_name),
  CASE WHEN document_version <> '' THEN concat(' (', document_version, ')') ELSE '' END, ' | ',
  CASE WHEN article_number <> '' THEN concat('Article ', article_number,
         CASE WHEN part_count > 1
           THEN concat(' — Part ', part_index + 1, '/', part_count) ELSE '' END)
       WHEN annex_number <> '' THEN concat('Annex ', annex_number)
       ELSE concat('Page ', coalesce(CAST(page_number AS VARCHAR), 'None')) END,
  ' | Page ', coalesce(CAST(page_number AS VARCHAR), 'None'), ']')"""
_CONTEXTS = (
    f"contexts AS (SELECT query_id, string_agg(concat({_HEADER}, chr(10), chunk_text), "
    "concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context "
    "FROM hits GROUP BY query_id)"
)


# -- context and prompts -----------------------------------------------------


@query(
    "context_block",
    RAG_HITS.rstrip() + f",\n{_CONTEXTS}\nSELECT query_id, context FROM contexts",
)
def context_block(spark, sf_dir):
    return context.build_context(rag_hits(spark, sf_dir))


@query(
    "source_block",
    RAG_HITS
    + """SELECT query_id, string_agg(concat('[Source ', rank, ']', chr(10), 'File: ', file_name,
      chr(10), 'Page: ', coalesce(CAST(page_number AS VARCHAR), 'None'),
      chr(10), 'Article: ', coalesce(article_number, 'None'),
      chr(10), 'Title: ', coalesce(title, 'None'),
      chr(10), 'Regulation: ', coalesce(regulation_family, 'None'),
      chr(10), 'Text:', chr(10), chunk_text), concat(chr(10), chr(10)) ORDER BY rank) AS context
    FROM hits GROUP BY query_id""",
)
def source_block(spark, sf_dir):
    return context.source_context(rag_hits(spark, sf_dir))


@query(
    "answer_sources",
    RAG_HITS
    + """SELECT query_id, rank AS source_index, chunk_uid, file_name AS source_file,
      page_number AS page, article_number, round(score, 6) AS score,
      round(distance, 6) AS distance, title, regulation_family, source_path,
      substr(chunk_text, 1, 1200) AS text FROM hits""",
)
def answer_sources(spark, sf_dir):
    """The sources listed next to an answer."""
    rows = context.sources(rag_hits(spark, sf_dir))
    return rows.withColumns(
        {c: F.round(c, 6) for c in ("score", "distance")}
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql() -> str:
    before, rest = context.PROMPT.split("{context}")
    between, after = rest.split("{question}")
    return (
        f"concat({_sql_text(before)}, context, {_sql_text(between)}, question, "
        f"{_sql_text(after)})"
    )


@query(
    "rag_prompt",
    RAG_HITS.rstrip()
    + f""",\n{_CONTEXTS}
    SELECT query_id, question, coalesce(context, '') AS context,
      CASE WHEN context IS NOT NULL THEN {_prompt_sql()} END AS prompt,
      CASE WHEN context IS NULL THEN {_sql_text(context.NO_RESULTS_ANSWER)} END AS answer
    FROM questions LEFT JOIN (
      SELECT q.query_id, c.context FROM questions q JOIN contexts c USING (query_id)
      JOIN hits h ON h.query_id = q.query_id AND h.rank = 1 AND h.score >= 0.8)
    USING (query_id)""",
)
def rag_prompt(spark, sf_dir):
    """Questions whose best hit scores below 0.8 count as without results."""
    hits = materialize(rag_hits(spark, sf_dir), "hits")
    found = hits.where("rank = 1 AND score >= 0.8").select("query_id")
    contexts = context.build_context(hits).join(found, "query_id", "left_semi")
    return context.rag_prompts(inputs.questions(spark, sf_dir), contexts)


def all_excerpts(questions: pd.Series, prompts: pd.Series) -> pd.Series:
    """A stand-in for a chat model: answers with the excerpts of the prompt."""
    excerpts = prompts.str.split("## Excerpts\n", n=1).str[1]
    return excerpts.str.rsplit("\n\n## Question\n", n=1).str[0]


@query(
    "ask",
    RAG_HITS.rstrip()
    + f""",\n{_CONTEXTS}
    SELECT query_id, question, context, context AS answer,
      NULL::VARCHAR AS error, uids AS chunk_uids, hit_count
    FROM questions JOIN contexts USING (query_id) JOIN (
      SELECT query_id, string_agg(chunk_uid, ',' ORDER BY rank) AS uids,
        count(*)::INTEGER AS hit_count FROM hits GROUP BY query_id) USING (query_id)""",
)
def ask(spark, sf_dir):
    records = rag.ask(
        inputs.questions(spark, sf_dir), rag_index(spark, sf_dir), all_excerpts, 5
    )
    return records.select(
        "query_id",
        "question",
        "context",
        "answer",
        "error",
        F.array_join("retrieved_chunks.chunk_uid", ",").alias("chunk_uids"),
        F.size("retrieved_chunks").alias("hit_count"),
    )


_SOURCE_BLOCKS = """string_agg(concat('[Source ', rank, ']', chr(10), 'File: ', file_name,
      chr(10), 'Page: ', coalesce(CAST(page_number AS VARCHAR), 'None'),
      chr(10), 'Article: ', coalesce(article_number, 'None'),
      chr(10), 'Title: ', coalesce(title, 'None'),
      chr(10), 'Regulation: ', coalesce(regulation_family, 'None'),
      chr(10), 'Text:', chr(10), chunk_text), concat(chr(10), chr(10)) ORDER BY rank)"""


@query(
    "ask_with_sources",
    RAG_HITS
    + f"""SELECT query_id, any_value(question) AS question, {_SOURCE_BLOCKS} AS answer,
      NULL::VARCHAR AS error, string_agg(chunk_uid, ',' ORDER BY rank) AS chunk_uids,
      string_agg(substr(chunk_text, 1, 1200), '|' ORDER BY rank) AS previews,
      string_agg(chunk_text, '|' ORDER BY rank) AS texts,
      round(sum(score), 5) AS score
    FROM hits GROUP BY query_id""",
)
def ask_with_sources(spark, sf_dir):
    records = rag.ask_with_sources(
        inputs.questions(spark, sf_dir), rag_index(spark, sf_dir), all_excerpts, 5
    )
    total = F.aggregate("retrieved_chunks.score", F.lit(0.0), lambda a, x: a + x)
    return records.select(
        "query_id",
        "question",
        "answer",
        "error",
        F.array_join("sources.chunk_uid", ",").alias("chunk_uids"),
        F.array_join("sources.text", "|").alias("previews"),
        F.array_join("retrieved_chunks.chunk_text", "|").alias("texts"),
        F.round(total, 5).alias("score"),
    )


# -- answers -----------------------------------------------------------------


@query("extract_citations", _ANSWERS + "SELECT * FROM cited")
def extract_citations(spark, sf_dir):
    return ans.extract_citations(inputs.answers(spark, sf_dir))


@query(
    "insufficient_answers",
    _ANSWERS
    + f"SELECT answer_id, answer FROM answers WHERE contains(answer, '{INSUFFICIENT}')",
)
def insufficient_answers(spark, sf_dir):
    return ans.insufficient_answers(inputs.answers(spark, sf_dir))


@query("citation_page_map", _ANSWERS + "SELECT answer_id, page, file, title FROM page_map")
def citation_page_map(spark, sf_dir):
    return ans.citation_page_map(inputs.retrieved_for_answers(spark, sf_dir))


@query(
    "link_citations",
    _ANSWERS
    + """SELECT answer_id, position, citation, page, file, title, file IS NOT NULL AS linked
    FROM cited LEFT JOIN page_map USING (answer_id, page)""",
)
def link_citations(spark, sf_dir):
    return ans.link_citations(
        ans.extract_citations(inputs.answers(spark, sf_dir)),
        ans.citation_page_map(inputs.retrieved_for_answers(spark, sf_dir)),
    )


# -- evaluation --------------------------------------------------------------


_EVALUATION = (
    sql.with_(
        sql.CENTROIDS,
        sql.CENTROID_SCORES,
        """own AS (SELECT query_id, score FROM scored WHERE query_id = label),
        contexts AS (SELECT query_id, rank, CASE WHEN label = query_id THEN 1 ELSE 0 END AS verdict
          FROM numbered_scores WHERE rank <= 20),
        at_rank AS (SELECT *, sum(verdict) OVER (PARTITION BY query_id ORDER BY rank) / rank
          AS p FROM contexts),
        scores AS (SELECT query_id, faithfulness, response_relevancy, context_precision
          FROM (SELECT query_id, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS faithfulness,
                  avg(score) AS response_relevancy FROM own GROUP BY query_id)
          JOIN (SELECT query_id, coalesce(sum(p * verdict) / nullif(sum(verdict), 0), 0.0)
                  AS context_precision FROM at_rank GROUP BY query_id) USING (query_id))""",
    )
)


def _scores(spark, sf_dir):
    """Labels as questions: their vectors are the statements (supported from a score
    of 0.5 on) and the regenerated questions; hits of the same label are relevant."""
    centroids = small_side(inputs.label_centroids(spark, sf_dir), "centroids")
    own = (
        inputs.vectors(spark, sf_dir)
        .withColumnRenamed("label", "query_id")
        .join(centroids, "query_id")
        .withColumnRenamed("embedding", "regenerated_vector")
    )
    statements = own.select(
        "query_id",
        (
            rounded_score(
                cosine_similarity(F.col("query_vector"), F.col("regenerated_vector"))
            )
            >= 0.5
        )
        .cast("int")
        .alias("verdict"),
    )
    hits = search.vector_search(
        inputs.vectors(spark, sf_dir), centroids, 20, keys=("vec_id",)
    )
    contexts = hits.select(
        "query_id", "rank", (F.col("label") == F.col("query_id")).cast("int").alias("verdict")
    )
    return evaluate.evaluate_scores(statements, own, contexts)


@query(
    "evaluate_scores",
    _EVALUATION
    + """SELECT query_id, round(faithfulness, 6) AS faithfulness,
      round(response_relevancy, 6) AS response_relevancy,
      round(context_precision, 6) AS context_precision FROM scores""",
)
def evaluate_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "query_id",
        *[
            F.round(c, 6).alias(c)
            for c in ("faithfulness", "response_relevancy", "context_precision")
        ],
    )


@query(
    "eval_csv_sink",
    _EVALUATION
    + """SELECT concat('label ', query_id) AS act,
      concat('Which vectors, "if any", belong to label ', query_id, '?') AS question,
      CAST(query_id AS VARCHAR) AS ground_truth, concat('those near', chr(10), 'its mean')
        AS answer, round(faithfulness, 6) AS faithfulness,
      round(response_relevancy, 6) AS response_relevancy,
      round(context_precision, 6) AS context_precision FROM scores""",
)
def eval_csv_sink(spark, sf_dir):
    label = F.col("query_id").cast("string")
    results = _scores(spark, sf_dir).select(
        F.concat(F.lit("label "), label).alias("act"),
        F.concat(F.lit('Which vectors, "if any", belong to label '), label, F.lit("?")).alias(
            "question"
        ),
        label.alias("ground_truth"),
        F.lit("those near\nits mean").alias("answer"),
        *[
            F.round(c, 6).alias(c)
            for c in ("faithfulness", "response_relevancy", "context_precision")
        ],
    )
    path = new_dir(spark, "eval-csv")
    file_sinks.write_eval_csv(results, path)
    schema = ", ".join(
        f"{c} {'string' if i < 4 else 'double'}" for i, c in enumerate(schemas.EVAL_COLUMNS)
    )
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def first_words(questions: pd.Series, prompts: pd.Series) -> pd.Series:
    """A stand-in that answers with the question's beginning and refuses some."""
    if questions.str.len().mod(7).eq(3).any():
        raise ValueError("no answer")
    return questions.str.slice(0, 40)


def counting_judge(kind: str, rows: pd.DataFrame) -> list[list[str]]:
    """A stand-in whose verdicts follow from lengths."""
    if kind == evaluation.REGENERATED:
        return [[answer] for answer in rows["answer"]]
    if kind == evaluation.USEFUL:
        return [[str(n % 2)] for n in rows["passage"].str.len()]
    return [["1", str(n % 2)] for n in rows["answer"].str.len()]


@query(
    "evaluation_run",
    RAG_HITS
    + f""", golden AS (SELECT item_id AS query_id, text AS question, substr(text, 1, 40) AS answer,
          {sql.embedding("text")} AS q, {sql.embedding("substr(text, 1, 40)")} AS a
        FROM benchmark WHERE length(text) % 7 <> 3),
      useful AS (SELECT query_id, rank, length(chunk_text) % 2 AS verdict FROM hits),
      at_rank AS (SELECT *, sum(verdict) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p
        FROM useful),
      precision_of AS (SELECT query_id, coalesce(sum(p * verdict) / nullif(sum(verdict), 0), 0.0)
        AS context_precision FROM at_rank GROUP BY query_id)
    SELECT 'benchmark' AS act, question, CAST(query_id AS VARCHAR) AS ground_truth, answer,
      (1 + length(answer) % 2) / 2 AS faithfulness,
      round({sql.cosine(sql.doubles("q"), sql.doubles("a"))}, 6) AS response_relevancy,
      round(context_precision, 6) AS context_precision
    FROM golden JOIN precision_of USING (query_id)""",
)
def evaluation_run(spark, sf_dir):
    """From questions to the rows of the CSV: search, answers, verdicts and scores."""
    golden = inputs.questions(spark, sf_dir).select(
        "query_id",
        F.lit("benchmark").alias("act"),
        "question",
        F.col("query_id").cast("string").alias("ground_truth"),
    )
    path = new_dir(spark, "evaluation")
    evaluation.evaluate_to_csv(
        f"{path}/csv", golden, rag_index(spark, sf_dir), first_words, counting_judge, path
    )
    schema = ", ".join(
        f"{c} {'string' if i < 4 else 'double'}" for i, c in enumerate(schemas.EVAL_COLUMNS)
    )
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    scores = reader.option("multiLine", True).csv(f"{path}/csv")
    rounded = ("faithfulness", "response_relevancy", "context_precision")
    return scores.withColumns({c: F.round(c, 6) for c in rounded})


def picky_model(questions: pd.Series, prompts: pd.Series) -> pd.Series:
    """A stand-in that fails on some questions."""
    if prompts.str.contains("the", regex=False).any():
        raise ValueError("cannot answer this")
    return questions


@query(
    "evaluate_failures",
    """SELECT concat(conv_id, '-', turn) AS query_id,
      CASE WHEN contains(text, 'the') THEN NULL ELSE text END AS answer,
      CASE WHEN contains(text, 'the') THEN 'ValueError: cannot answer this' END AS error
    FROM conversations WHERE role = 'user'""",
)
def evaluate_failures(spark, sf_dir):
    """Every user turn is asked; the model fails on those with a certain word."""
    asked = (
        inputs.table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("query_id"),
            F.col("text").alias("question"),
            F.lit("").alias("context"),
            F.col("text").alias("prompt"),
            F.lit(None).cast("string").alias("answer"),
        )
    )
    good, bad = evaluate.split_failures(context.generate_answers(asked, picky_model))
    return good.select("query_id", "answer", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("query_id", "answer", "error")
    )


# -- composite builds --------------------------------------------------------


@query(
    "medallion_build",
    sql.LEGAL_CHUNKS
    + """SELECT * FROM (
      SELECT 'bronze_raw_documents' AS table_name, (SELECT count(*) FROM bronze) AS row_count
      UNION ALL SELECT 'silver_extracted_pages', (SELECT count(*) FROM legal_pages)
      UNION ALL SELECT 'silver_chunks', (SELECT count(*) FROM silver)
      UNION ALL SELECT 'gold_ai_ready_chunks', (SELECT count(*) FROM gold)
      UNION ALL SELECT 'gold_embedded_chunks', (SELECT count(*) FROM gold))""",
)
def medallion_build(spark, sf_dir):
    return medallion.build(
        spark,
        inputs.scratch_target(spark),
        files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT),
        inputs.legal_pages(spark, sf_dir),
    )


@query("rag_ingest", sql.LEGAL_CHUNKS + "SELECT * FROM rag_chunks")
def rag_ingest(spark, sf_dir):
    return rag.ingest(inputs.legal_pages(spark, sf_dir))


@query(
    "ingest_all",
    sql.LEGAL_CHUNKS
    + """SELECT document_id, CASE WHEN bad THEN 0 ELSE coalesce(n, 0) END AS chunk_count,
      CASE WHEN bad THEN 0 ELSE labels END AS indexed,
      CASE WHEN bad THEN 'ValueError: unreadable file' END AS error
    FROM (SELECT document_id, contains(full_text, 'Clause ') AS bad FROM legal_documents)
    LEFT JOIN (SELECT document_id, count(*) AS n, count(DISTINCT chunk_uid) AS labels
               FROM chunks GROUP BY document_id) USING (document_id)""",
)
def ingest_all(spark, sf_dir):
    """All files into a fresh store; those that cannot be read are reported.

    Chunk counts come from the written registry and, distinct labels, the index.
    """
    extracted = files.extract_pages(
        inputs.legal_file_contents(spark, sf_dir), inputs.form_feed_pages, "stand-in"
    )
    store = library.Library(new_dir(spark, "library"), buckets=8)
    _, failures = library.ingest_run(extracted, store, "all", recreate=True)
    indexed = (
        store.read(spark, library.INDEX)
        .groupBy("document_id")
        .agg(F.count("*").alias("indexed"))
    )
    done = (
        store.read(spark, library.REGISTRY)
        .join(indexed, "document_id", "left")
        .select("document_id", "chunk_count", "indexed", F.lit(None).cast("string").alias("error"))
    )
    none = F.lit(0).cast("bigint")
    return done.unionByName(
        failures.select(
            "document_id", none.alias("chunk_count"), none.alias("indexed"), "error"
        )
    )


@query(
    "reindex_json",
    sql.LEGAL_CHUNKS
    + f"""SELECT chunk_uid, document_id, chunk_id, page_number, title, regulation_title,
      chunk_text, {sql.vector_facts()}
    FROM (SELECT *, {sql.embedding("chunk_text")} AS embedding,
        row_number() OVER (PARTITION BY chunk_uid ORDER BY chunk_id DESC) AS rn FROM rag_chunks)
    WHERE rn = 1""",
)
def reindex_json(spark, sf_dir):
    """The chunk JSON of a store, read back and indexed without the documents."""
    pages = inputs.legal_pages(spark, sf_dir)
    store = rag.Store(
        inputs.scratch_target(spark), new_dir(spark, "json"), new_dir(spark, "registry")
    )
    chunks = materialize(rag.ingest(pages), "chunks")
    documents = file_sinks.chunk_documents_json(chunks, rag.registry_rows(pages, chunks))
    file_sinks.write_chunk_json(documents, f"{store.json_dir}/first")
    rag.reindex(spark, store)
    return tables.table_scan(spark, store.target, store.index).select(
        "chunk_uid", "document_id", "chunk_id", "page_number", "title", "regulation_title",
        "chunk_text", *inputs.vector_facts(),
    )
