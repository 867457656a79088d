"""Vector functions and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.catalog import inputs, sql
from lexweave.catalog.registry import query
from lexweave.functions import vectors
from lexweave.functions.text import preview
from lexweave.operators import inverted_lists as lists
from lexweave.operators import report, search
from lexweave.operators.embed import embed_chunks, embed_questions
from lexweave.plans import rag
from lexweave.sources import files
from lexweave.storage import materialize, new_dir

_CENTROIDS = sql.with_(sql.CENTROIDS, sql.CENTROID_SCORES)
_VEC = ("vec_id",)


def _six(column: str):
    return F.round(column, 6).alias(column)


def plain_index(spark, sf_dir):
    """The embedded windows of all plain documents, as a written table."""
    embedded = embed_chunks(inputs.plain_chunks(spark, sf_dir))
    return materialize(embedded.drop("embedding_model", "embedding_version"), "plain-index")


def rag_index(spark, sf_dir):
    """The embedded chunks of all legal documents, as a written table."""
    pages = inputs.legal_pages(spark, sf_dir)
    rows = files.document_rows(inputs.legal_files(spark, sf_dir), inputs.RAW_ROOT)
    chunks = rag.ingest(pages).join(
        rows.select("document_id", "source_path", "source_name", "regulation_family"),
        "document_id",
        "left",
    )
    embedded = embed_chunks(chunks).drop("embedding_model", "embedding_version")
    return materialize(embedded, "rag-index")


RAG_HITS = sql.with_(
    sql.LEGAL,
    sql.BRONZE,
    sql.chunks("legal_documents"),
    sql.TAGGED,
    sql.META,
    """rag_rows AS (SELECT rag_chunks.*, source_path, source_name, regulation_family
      FROM rag_chunks LEFT JOIN bronze USING (document_id))""",
    sql.QUESTIONS,
    sql.ranked("rag_rows", 5),
)


# -- vector functions --------------------------------------------------------


_HOLES = "transform(embedding, (x, i) -> CASE WHEN (vec_id + i) % 5 = 0 THEN NULL ELSE x END)"


@query(
    "normalize_vector",
    f"""SELECT vec_id, {sql.vector_facts("v")}, {sql.vector_facts("n").replace(
        " AS dims", " AS nested_dims").replace(" AS non_zero", " AS nested_non_zero").replace(
        " AS weighted_sum", " AS nested_weighted_sum")}
    FROM (SELECT vec_id,
      CASE WHEN label = 9 THEN [] ELSE list_filter([CASE WHEN (vec_id + i - 1) % 5 = 0 THEN NULL
        ELSE embedding[i] END for i in range(1, 65)], lambda x: x IS NOT NULL) END AS v,
      list_filter([CASE WHEN (vec_id + i) % 3 = 0 THEN NULL ELSE embedding[i] END
        for i in range(1, 64)], lambda x: x IS NOT NULL) AS n
      FROM embeddings)""",
)
def normalize_vector(spark, sf_dir):
    """Vectors with null elements, null vectors, and vectors of short lists."""
    broken = f"CASE WHEN label <> 9 THEN {_HOLES} END"
    nested = """transform(slice(embedding, 1, 63), (x, i) ->
        CASE WHEN (vec_id + i + 1) % 3 = 0 THEN array() ELSE array(0.5F, x) END)"""
    rows = inputs.vectors(spark, sf_dir).selectExpr(
        "vec_id", f"{broken} AS broken", f"{nested} AS nested"
    )
    normal = rows.select(
        "vec_id",
        vectors.normalize_vector(F.col("broken")).alias("v"),
        vectors.normalize_nested_vector(F.col("nested")).alias("n"),
    )
    names = ("dims", "non_zero", "weighted_sum")
    return normal.select(
        "vec_id",
        *inputs.vector_facts("v"),
        *[c.alias(f"nested_{n}") for c, n in zip(inputs.vector_facts("n"), names)],
    )


_DISTORTED = (
    "CASE label WHEN 0 THEN NULL WHEN 1 THEN slice(embedding, 1, 40) "
    "WHEN 2 THEN transform(embedding, x -> CAST(0 AS FLOAT)) ELSE embedding END"
)
_COSINES = (
    sql.with_(
        sql.CENTROIDS,
        f"""shaped AS (SELECT vec_id, label,
          CASE label WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN {sql.doubles("embedding[1:40]")}
            WHEN 2 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
            ELSE {sql.doubles("embedding")} END AS v FROM embeddings),
        cosines AS (SELECT vec_id, CASE WHEN len(v) = 0 THEN 0.0
          ELSE {sql.cosine("v", "qv[1:len(v)]")} END AS s FROM shaped, mean_vector)""",
    )
)


def _cosines(spark, sf_dir):
    rows = inputs.vectors(spark, sf_dir).select(
        "vec_id",
        F.expr(_DISTORTED).alias("v"),
        inputs.mean_vector(spark, sf_dir).scalar().alias("q"),
    )
    similarity = vectors.cosine_similarity(F.col("q"), F.col("v"))
    return rows.select("vec_id", vectors.rounded_score(similarity).alias("s"))


@query("cosine_similarity", _COSINES + "SELECT vec_id, round(s, 6) AS similarity FROM cosines")
def cosine_similarity(spark, sf_dir):
    """Against the mean vector; some vectors are null, short or zero."""
    return _cosines(spark, sf_dir).select("vec_id", F.round("s", 6).alias("similarity"))


@query("cosine_distance", _COSINES + "SELECT vec_id, round(1.0 - s, 6) AS distance FROM cosines")
def cosine_distance(spark, sf_dir):
    return _cosines(spark, sf_dir).select(
        "vec_id", F.round(vectors.cosine_distance(F.col("s")), 6).alias("distance")
    )


# -- one query ---------------------------------------------------------------


_MEAN_SCORES = sql.with_(
    sql.CENTROIDS,
    f"""mean_scores AS (SELECT vec_id, label, {sql.cosine("qv", sql.doubles("embedding"))}
      AS score FROM embeddings, mean_vector)""",
)


def _scored_by_mean(spark, sf_dir):
    query_vector = inputs.mean_vector(spark, sf_dir).scalar()
    return search.score_chunks(inputs.vectors(spark, sf_dir), query_vector)


@query(
    "score_pairs",
    _MEAN_SCORES
    + """SELECT vec_id, round(score, 6) AS score, round(1.0 - score, 6) AS distance
    FROM mean_scores""",
)
def score_pairs(spark, sf_dir):
    """Every vector scored against one query, the mean vector."""
    return _scored_by_mean(spark, sf_dir).select("vec_id", _six("score"), _six("distance"))


@query(
    "topk_single",
    _MEAN_SCORES
    + """SELECT vec_id, label, round(score, 6) AS score FROM mean_scores
    ORDER BY mean_scores.score DESC, vec_id LIMIT 5""",
)
def topk_single(spark, sf_dir):
    best = search.top_k_single(_scored_by_mean(spark, sf_dir), 5, _VEC)
    return best.select("vec_id", "label", _six("score"))


# -- many queries ------------------------------------------------------------


def _centroid_hits(spark, sf_dir, top_k):
    return search.nearest(
        inputs.vectors(spark, sf_dir), inputs.label_centroids(spark, sf_dir), top_k, keys=_VEC
    )


@query(
    "topk_batch",
    _CENTROIDS
    + """SELECT query_id, rank, vec_id, round(score, 6) AS score FROM numbered_scores
    WHERE rank <= 3""",
)
def topk_batch(spark, sf_dir):
    return _centroid_hits(spark, sf_dir, 3).select("query_id", "rank", "vec_id", _six("score"))


@query(
    "topk_pruned",
    f"""SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
      SELECT query_id, vec_id, score, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
      FROM (SELECT q.vec_id AS query_id, c.vec_id,
          {sql.cosine("q.v", "c.v")} AS score
        FROM (SELECT vec_id, {sql.doubles("embedding")} AS v FROM embeddings
              WHERE vec_id % 50 = 0) q,
          (SELECT vec_id, {sql.doubles("embedding")} AS v FROM embeddings) c))
    WHERE rank <= 5""",
)
def topk_pruned(spark, sf_dir):
    """Every 50th vector against all, as more queries than one task takes are searched."""
    rows = inputs.vectors(spark, sf_dir)
    asked = rows.where(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    hits = search.nearest(rows, asked, 5, keys=_VEC, max_shipped=0, block_rows=256)
    return hits.select("query_id", "rank", "vec_id", _six("score"))


@query(
    "source_numbering",
    _CENTROIDS
    + "SELECT query_id, rank AS source_index, vec_id FROM numbered_scores WHERE rank <= 20",
)
def source_numbering(spark, sf_dir):
    return _centroid_hits(spark, sf_dir, 20).select(
        "query_id", F.col("rank").alias("source_index"), "vec_id"
    )


@query(
    "ann_search",
    sql.with_(
        sql.CENTROIDS,
        """planes AS (SELECT h, i,
          CASE WHEN substr(md5(concat(h, ':', i - 1)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS sign
          FROM range(0, 8) a(h), range(1, 65) b(i)),
        margins AS (SELECT query_id, h, sum(sign * qv[i]) AS m
          FROM centroids, planes GROUP BY query_id, h),
        costs AS (SELECT query_id, code,
          sum(CASE WHEN (m > 0) <> ((code >> h) & 1 = 1) THEN abs(m) ELSE 0 END) AS cost
          FROM margins, range(0, 256) c(code) GROUP BY query_id, code),
        probes AS (SELECT query_id, code FROM (SELECT *,
          row_number() OVER (PARTITION BY query_id ORDER BY cost, code) AS rn FROM costs)
          WHERE rn <= 96),
        bucketed AS (SELECT vec_id, any_value(embedding) AS embedding, sum(bit) AS code FROM (
          SELECT vec_id, any_value(embedding) AS embedding, h,
            CASE WHEN sum(sign * CAST(embedding[i] AS DOUBLE)) > 0 THEN 1 << h ELSE 0 END AS bit
          FROM embeddings, planes GROUP BY vec_id, h) GROUP BY vec_id)""",
        f"""near AS (SELECT query_id, vec_id, {sql.cosine("qv", sql.doubles("embedding"))} AS score
          FROM bucketed JOIN probes USING (code) JOIN centroids USING (query_id))""",
    )
    + """SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
        AS rank FROM near) WHERE rank <= 5""",
)
def ann_search(spark, sf_dir):
    """Label centroids against an index of all vectors written by bucket."""
    buckets = search.Buckets("bucket", inputs.VECTOR_DIMENSIONS)
    indexed = search.write_ann_index(
        inputs.vectors(spark, sf_dir), "embedding", buckets, new_dir(spark, "ann-index"), _VEC
    )
    hits = search.ann_search(
        indexed, inputs.label_centroids(spark, sf_dir), buckets, 5, keys=_VEC
    )
    return hits.select("query_id", "rank", "vec_id", _six("score"))


def _list_index(spark, rows):
    """An index of vectors, with about as many lists as rows in a list."""
    index = lists.ListIndex(new_dir(spark, "list-index"), _VEC)
    lists.build(rows, index, lists=max(16, int(rows.count() ** 0.5)), parts=32)
    return index


@query(
    "ann_lists",
    """SELECT vec_id AS query_id, least(5, (SELECT count(*) FROM embeddings))::BIGINT AS results,
      0::BIGINT AS wrong_scores, true AS recall_reached
    FROM embeddings WHERE vec_id % 50 = 0""",
)
def ann_lists(spark, sf_dir):
    """Every 50th vector against inverted lists of all: rows for each query, scores that
    differ from those of exact search, and whether 0.9 of the exact results are found."""
    rows = inputs.vectors(spark, sf_dir).select("vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    hits = lists.search(spark, _list_index(spark, rows), asked, 5)
    true = search.nearest(rows, asked, 5, keys=_VEC).select(
        "query_id", "vec_id", F.col("score").alias("true_score")
    )
    both = hits.join(true, ["query_id", "vec_id"], "full")
    far = F.abs(F.col("score") - F.col("true_score")) > 1e-6
    found = (F.count_if(F.col("score").isNotNull() & F.col("true_score").isNotNull())).alias("found")
    counted = materialize(
        both.groupBy("query_id").agg(
            F.count("score").alias("results"),
            F.count_if(far).alias("wrong_scores"),
            found,
            F.count("true_score").alias("wanted"),
        ),
        "counted",
    )
    share = counted.agg((F.sum("found") >= 0.9 * F.sum("wanted")).alias("recall_reached"))
    return counted.select("query_id", "results", "wrong_scores").join(F.broadcast(share))


@query(
    "ann_lists_upserts",
    """SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS direction
    FROM embeddings WHERE vec_id % 10 <> 7""",
)
def ann_lists_upserts(spark, sf_dir):
    """Lists of half the vectors, three upserts that add, turn round and remove some, and
    maintenance: which vectors are left, and which way they point."""
    rows = inputs.vectors(spark, sf_dir).select("vec_id", "embedding")
    turned = rows.withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = _list_index(spark, rows.where("vec_id % 2 = 0"))
    lists.upsert(rows.where("vec_id % 4 = 1"), index)
    lists.upsert(
        rows.where("vec_id % 4 = 3").unionByName(turned.where("vec_id % 10 = 0")), index
    )
    lists.upsert(
        turned.where("vec_id % 10 = 5"), index, rows.where("vec_id % 10 = 7").select("vec_id")
    )
    lists.maintain(spark, index, max_rows=max(16, int(1.5 * rows.count() ** 0.5)))
    versions = index.versions(spark)
    left = lists.live(versions, versions.manifest())
    direction = F.round(vectors.cosine_similarity(F.col("unit"), F.col("embedding")), 6)
    return left.join(rows, "vec_id").select("vec_id", direction.alias("direction"))


@query(
    "vector_search",
    sql.with_(
        sql.PLAIN, sql.chunks("plain_documents"), sql.QUESTIONS, sql.ranked("chunks", 5)
    )
    + """SELECT query_id, rank, chunk_uid, document_id, chunk_id, chunk_text,
      round(score, 6) AS score, round(distance, 6) AS distance FROM hits""",
)
def vector_search(spark, sf_dir):
    """All benchmark passages against the windows of all documents."""
    asked = embed_questions(inputs.questions(spark, sf_dir))
    hits = search.vector_search(plain_index(spark, sf_dir), asked, 5)
    return hits.select(
        "query_id",
        "rank",
        "chunk_uid",
        "document_id",
        "chunk_id",
        "chunk_text",
        _six("score"),
        _six("distance"),
    )


def rag_hits(spark, sf_dir, top_k=5):
    return rag.retrieve(inputs.questions(spark, sf_dir), rag_index(spark, sf_dir), top_k)


@query(
    "retrieve",
    RAG_HITS
    + """SELECT query_id, rank, chunk_uid, chunk_id, regulation_title, article_number,
      page_number, chunk_text, round(score, 6) AS score FROM hits""",
)
def retrieve(spark, sf_dir):
    return rag_hits(spark, sf_dir).select(
        "query_id",
        "rank",
        "chunk_uid",
        "chunk_id",
        "regulation_title",
        "article_number",
        "page_number",
        "chunk_text",
        _six("score"),
    )


@query(
    "search_row_shape",
    RAG_HITS
    + """SELECT query_id, rank, chunk_uid, article_number, title, regulation_family,
      file_name AS source_file, page_number AS page, chunk_text AS text,
      round(score, 6) AS score, round(distance, 6) AS distance, document_id, file_name,
      chunk_id, page_number, char_length, source_name, source_path FROM hits""",
)
def search_row_shape(spark, sf_dir):
    shaped = search.search_rows(rag_hits(spark, sf_dir))
    return shaped.withColumns({"score": _six("score"), "distance": _six("distance")}).select(
        *[c for c in shaped.columns if c != "metadata"], "metadata.*"
    )


@query(
    "search_summary",
    _CENTROIDS
    + """SELECT c.query_id, count(n.vec_id) AS hits, round(max(n.score), 6) AS top_score
    FROM centroids c LEFT JOIN numbered_scores n
      ON c.query_id = n.query_id AND n.rank <= 5 AND n.score >= 0.6
    GROUP BY c.query_id""",
)
def search_summary(spark, sf_dir):
    """Hits that reach a score of 0.6, per label centroid."""
    hits = _centroid_hits(spark, sf_dir, 5).where("score >= 0.6")
    summary = report.search_summary(inputs.label_centroids(spark, sf_dir), hits)
    return summary.select("query_id", "hits", _six("top_score"))


@query(
    "retrieval_smoke",
    sql.with_(
        sql.LEGAL,
        sql.BRONZE,
        sql.chunks("legal_documents"),
        sql.TAGGED,
        sql.META,
        sql.SMOKE,
        sql.ranked("rag_chunks", 3),
    )
    + """SELECT question, rank, regulation_title, article_number, round(score, 3) AS score,
      substr(chunk_text, 1, 80) AS shown FROM hits""",
)
def retrieval_smoke(spark, sf_dir):
    hits = rag.retrieve(inputs.smoke_questions(spark), rag_index(spark, sf_dir), 3)
    return hits.join(inputs.smoke_questions(spark), "query_id").select(
        "question",
        "rank",
        "regulation_title",
        "article_number",
        F.round("score", 3).alias("score"),
        preview(F.col("chunk_text"), 80).alias("shown"),
    )
