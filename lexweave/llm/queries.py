"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import (
    byte_bpe,
    exact_dedup,
    fill_middle,
    html_text,
    jaccard_join,
    language,
    line_dedup,
    mixing,
    pieces,
    token_files,
    topk_search,
    toxicity,
    whitening,
)
from lexweave.llm.tables import crc32_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256,
        row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept FROM t)
    SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query(
    "op2_topk_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding,
            lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
            list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.exact_topk(vectors, F.col("vec_id") % 100 == 0, k=10)


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@query(
    "op4_jaccard_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
            WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]
                for i in range(1, len(ws) - 1)]) END AS sh FROM w),
    e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b
            ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    reach AS (SELECT doc_id AS node, doc_id AS label FROM documents
        UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.node)
    SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, component_id
    FROM s JOIN (SELECT node, min(label) AS component_id FROM reach GROUP BY node) c
        ON c.node = s.doc_id
    """,
)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    identifier = language.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language.identify(docs, identifier).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted"
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", toxicity.toxicity_score(model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= corpus_pipeline.TOXIC_FROM).cast("int").alias("predicted"),
    )


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(corpus_pipeline.PIECES_MODEL),
        keep=["doc_id"],
    )


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    encoded = byte_bpe.encode_rows(
        docs, path, public_tokenizers.PATTERN, keep=["doc_id"], decoded=True
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=8)


@query(
    "op13_fill_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
            sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
            CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
            CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
            greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM u),
    p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
            array_to_string(w[b + 1:], '') AS s FROM c)
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p
    """,
)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.cut_pieces(table(spark, sf_dir, "documents")))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
