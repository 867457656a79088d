from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.catalog.chunking import load_hash_model
from lexweave.functions import vectors as V
from lexweave.operators import embed, search
from tests.conftest import plan_of

KEYS = ("chunk_uid", "chunk_id")


def cosine(a, b):
    """Plain restatement: common length, zero for empty or zero vectors."""
    a, b = [x for x in a or [] if x is not None], [x for x in b or [] if x is not None]
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    scale = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / scale, 9) if scale else 0.0


def chunk_frame(spark, vectors):
    rows = [(f"u{i % 40:03d}", i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_uid string, chunk_id int, embedding array<float>")


def query_frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "query_id bigint, query_vector array<double>")


def brute_force(chunks, queries, k):
    rows = [(r.chunk_uid, r.chunk_id, r.embedding) for r in chunks.collect()]
    out = set()
    for q in queries.collect():
        best = sorted((-cosine(q.query_vector, v), u, i) for u, i, v in rows)[:k]
        out |= {(q.query_id, u, i, -s, n) for n, (s, u, i) in enumerate(best, start=1)}
    return out


def found(df):
    return {(r.query_id, r.chunk_uid, r.chunk_id, r.score, r["rank"]) for r in df.collect()}


def approximately(rows):
    return {(q, u, i, round(s, 7), n) for q, u, i, s, n in rows}


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(7)
    out = []
    for i in range(300):
        v = [float(x) for x in rng.integers(-3, 4, size=6)]
        if i % 17 == 0:
            v = None
        elif i % 13 == 0:
            v = [0.0] * 6
        elif i % 11 == 0:
            v = v[:3]
        elif i % 7 == 0:
            v[2] = None
        elif i % 5 == 0:
            v = [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]
        out.append(v)
    return out


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ([1.0, 0.0, 5.0], [1.0, 0.0], 1.0),
        ([0.0, 0.0], [1.0, 1.0], 0.0),
        (None, [1.0], 0.0),
        ([], [1.0], 0.0),
        ([3.0, 4.0], [4.0, 3.0], 0.96),
        ([None, 3.0, 4.0], [4.0, 3.0], 0.96),
    ],
)
def test_cosine_similarity(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    value = row.select(V.cosine_similarity(F.col("a"), F.col("b")).alias("s")).collect()[0].s
    assert value == pytest.approx(expected)


def test_normalize_nested_vector(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [], None, [5.0]],)], "v array<array<double>>")
    assert row.select(V.normalize_nested_vector(F.col("v")).alias("n")).collect()[0].n == [2.0, 5.0]


def test_hash_embedding_is_the_batch_model(spark):
    texts = ["Law of the data, law!", "", "Stra\u00dfe \u00c9T\u00c9 12", "!!!"]
    df = spark.createDataFrame([(t,) for t in texts], "chunk_text string")
    rows = embed.embed_chunks(df).collect()
    want = load_hash_model()(np.array(texts, dtype=object))
    for row, vector in zip(rows, want):
        assert row.embedding == [float(x) for x in vector]
        assert row.embedding_model == V.HASH_MODEL
    batched = embed.embed_chunks(df, embed.model_encoder(load_hash_model, 2), "m", "v").collect()
    assert [r.embedding for r in batched] == [r.embedding for r in rows]


def test_batch_search_is_brute_force(spark, odd_vectors):
    chunks = chunk_frame(spark, odd_vectors).repartition(5)
    queries = query_frame(spark, odd_vectors[:25] + [[1.0], [0.0] * 6, None])
    want = approximately(brute_force(chunks, queries, 7))
    assert approximately(found(search.nearest(chunks, queries, 7))) == want
    blocks = search.nearest(chunks, queries, 7, max_shipped=3, block_rows=16)
    assert approximately(found(blocks)) == want


def test_single_search_is_brute_force(spark, odd_vectors):
    chunks = chunk_frame(spark, odd_vectors)
    query = [1.0, -2.0, 0.5, 0.0, 1.0, 3.0]
    scored = search.score_chunks(chunks, F.array(*[F.lit(x) for x in query]))
    best = search.top_k_single(scored, 9)
    got = {(0, r.chunk_uid, r.chunk_id, r.score, n) for n, r in enumerate(best.collect(), 1)}
    assert approximately(got) == approximately(brute_force(chunks, query_frame(spark, [query]), 9))
    assert all(r.distance == 1.0 - r.score for r in best.collect())


def test_no_queries_and_no_chunks(spark, odd_vectors):
    chunks = chunk_frame(spark, odd_vectors)
    queries = query_frame(spark, [[1.0] * 6])
    assert search.nearest(chunks, queries.limit(0)).count() == 0
    assert search.nearest(chunks.limit(0), queries).count() == 0


@pytest.mark.parametrize("top_k", [0, -1])
def test_top_k_must_be_positive(spark, top_k):
    chunks, queries = chunk_frame(spark, [[1.0]]), query_frame(spark, [[1.0]])
    with pytest.raises(ValueError):
        search.nearest(chunks, queries, top_k)
    with pytest.raises(ValueError):
        search.check_top_k(21, 20)


def test_two_chunks_two_results(spark):
    """Small vectors, k = 2, results with chunk columns."""
    rows = [("a", 1, "hello world", [0.1, 0.2, 0.3]), ("b", 2, "foo bar", [0.4, 0.5, 0.6])]
    chunks = spark.createDataFrame(rows, "chunk_uid string, chunk_id int, chunk_text string, embedding array<float>")
    queries = query_frame(spark, [[0.1, 0.2, 0.3]])
    hits = search.vector_search(chunks, queries, 2).orderBy("rank").collect()
    assert [h.chunk_text for h in hits] == ["hello world", "foo bar"]
    assert [h.distance for h in hits] == [pytest.approx(0.0), pytest.approx(1 - hits[1].score)]


def test_approximate_search_recalls_most(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    buckets = search.Buckets("bucket", 64)
    indexed = search.with_bucket(vectors, "embedding", buckets)
    keys = ("vec_id",)
    exact = {(r.query_id, r.vec_id) for r in search.nearest(vectors, queries, 5, keys=keys).collect()}
    hits = search.ann_search(indexed, queries, buckets, 5, keys=keys)
    near = {(r.query_id, r.vec_id) for r in hits.collect()}
    blocked = search.ann_search(indexed, queries, buckets, 5, keys=keys, max_shipped=10, block_rows=200)
    assert {(r.query_id, r.vec_id) for r in blocked.collect()} == near
    assert len(exact) == 2500
    assert len(exact & near) / len(exact) > 0.6
    assert all((r.vec_id, r.vec_id) in near for r in vectors.collect())


def test_ann_index_scan_is_filtered(spark, sf_dir, tmp_path):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    buckets = search.Buckets("bucket", 64, probed_share=0.02)
    indexed = search.write_ann_index(vectors, "embedding", buckets, str(tmp_path / "ann"), ("vec_id",))
    query = vectors.limit(1).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    hits = search.ann_search(indexed, query, buckets, 5, keys=("vec_id",))
    formatted = hits._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters: [In(bucket, " in formatted
    assert indexed.count() == vectors.count()


def test_plans(spark, sf_dir, odd_vectors):
    chunks = chunk_frame(spark, odd_vectors)
    scored = search.score_chunks(chunks, F.array(F.lit(1.0), F.lit(2.0)))
    assert "TakeOrderedAndProject" in plan_of(search.top_k_single(scored, 3))
    batch = plan_of(search.nearest(chunks, query_frame(spark, [[1.0, 2.0]]), 3))
    assert "WindowGroupLimit" in batch and "MapInArrow" in batch
    for plan in (batch, plan_of(scored)):
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_validation_counts(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],)], "embedding array<float>")
    assert embed.missing_embeddings(df).collect()[0].violations == 1
    assert embed.wrong_dimensions(df, 2).collect()[0].violations == 2
    with pytest.raises(Exception, match="chunk without embedding"):
        embed.require_embeddings(df).collect()


def test_null_encoding(spark):
    row = spark.createDataFrame(
        [("u", "f.pdf", None, 3, "annex", None, None, None, 0, 1, None, None, None, None)],
        "chunk_uid string, file_name string, page_number int, chunk_id int, chunk_type string, "
        "article_number string, annex_number string, title string, part_index int, "
        "part_count int, law_passed_date date, regulation_title string, "
        "document_version string, issuing_authority string",
    )
    encoded = search.encode_nulls(row).collect()[0].asDict()
    assert encoded["page_number"] == -1
    assert {encoded[c] for c in ("title", "law_passed_date", "annex_number")} == {""}
    assert None not in encoded.values()


def pruned(spark, chunks, queries, k, block_rows):
    from pyspark.sql.types import DoubleType, StructField, StructType

    from lexweave.operators.block_search import nearest_pruned

    left = chunks.select(*KEYS, "embedding")
    schema = StructType([queries.schema["query_id"], *[left.schema[c] for c in KEYS], StructField("score", DoubleType())])
    return nearest_pruned(left, queries.select("query_id", "query_vector"), k, schema, block_rows)


def test_blocks_around_pivots_are_pruned_and_exact(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    vectors = [(centres[i % 20] + rng.normal(scale=0.05, size=12)).astype(np.float32).tolist() for i in range(1000)]
    chunks = chunk_frame(spark, vectors)
    queries = query_frame(spark, [v for v in vectors[:60]])
    hits, share = pruned(spark, chunks, queries, 5, 50)
    assert share > 0.5
    want = search.nearest(chunks, queries, 5)
    key = lambda df: sorted((r.query_id, r.chunk_uid, r.chunk_id, r.score) for r in df.collect())
    got = search.numbered_results(hits).where(F.col("rank") <= 5)
    assert key(got) == key(want)
    assert key(search.nearest(chunks, queries, 5, max_shipped=10, block_rows=50)) == key(want)


def test_pruned_search_takes_odd_vectors(spark, odd_vectors):
    chunks, queries = chunk_frame(spark, odd_vectors), query_frame(spark, odd_vectors[:40] + [None, [], [0.0, 0.0]])
    key = lambda df: sorted((r.query_id, r.chunk_uid, r.chunk_id, r.score) for r in df.collect())
    want = key(search.nearest(chunks, queries, 7))
    assert key(search.nearest(chunks, queries, 7, max_shipped=3, block_rows=20)) == want
    assert key(search.nearest(chunks.limit(0), queries, 7, max_shipped=3)) == []
    plan = plan_of(search.nearest(chunks, queries, 7, max_shipped=3, block_rows=20))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
