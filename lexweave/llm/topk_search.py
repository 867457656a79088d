"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers, ``floor(scale * x)``.  The queries are cut into slices of about
``SLICE_QUERIES``, each a broadcast of bounded size and one pass over all candidates.  A
task takes its candidates in blocks: dimension by dimension the non-zero values of the
block are the postings, and every query with a weight there adds weight times value to
its row of a dense score array.  The best of each block are selected by partition and
merged into the best of the task; the best of all tasks meet in one shuffle.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id.  Missing dimensions count as 0.  A query's own rows (its id) are no
candidates; of several rows with a query's id the smallest vector is the query.  Ties go
to the smaller id.  Scores are exact; components of 62 bits or more after scaling, and scores
of as many, end the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.storage import materialize, new_dir

SLICE_QUERIES = 2048
BLOCK_ROWS = 1024
NOTHING = -(1 << 62)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return (
        df.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)
        .select("vec_id", F.transform("vector", lambda x: whole(x * scale)).alias("vector"))
    )


def whole(x: Column) -> Column:
    """The integer at or below a double; the job ends if none of 62 bits is."""
    message = F.lit("a component is too large for exact integer scores")
    return F.when(F.abs(x) < F.lit(float(1 << 62)), F.floor(x)).otherwise(
        F.raise_error(message).cast("long")
    )


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of integers, padded with zeros to one length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def accumulate(terms: list[tuple[np.ndarray, np.ndarray]], n: int, block: np.ndarray):
    """Scores (query, candidate), one dimension after the other.

    Where sums could pass 62 bits they are taken over Python's integers; a score that does
    not fit a long integer ends the job."""
    reach = 0
    for (_, weights), values in zip(terms, block.T, strict=False):
        reach += _largest(weights) * _largest(values)
    if reach >= 1 << 62:
        exact = _accumulate([(q, w.astype(object)) for q, w in terms], n, block.astype(object))
        if _largest(exact) >= 1 << 62:
            raise ArithmeticError("a score is too large for a long integer")
        return exact.astype(np.int64)
    return _accumulate(terms, n, block)


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0))) if values.size else 0


def _accumulate(terms: list[tuple[np.ndarray, np.ndarray]], n: int, block: np.ndarray):
    scores = np.zeros((n, len(block)), block.dtype)
    for (queries, weights), values in zip(terms, block.T, strict=False):
        at = np.flatnonzero(values)
        if not len(queries) or not len(at):
            continue
        products = np.multiply.outer(weights, values[at])
        if len(at) == len(values):
            scores[queries] += products
        else:
            scores[queries[:, None], at] += products
    return scores


def best_of_block(scores: np.ndarray, ids: np.ndarray, k: int):
    """(scores, ids) of each row's k best columns; ``ids`` ascend, ties take the first."""
    k = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = scores > floor, scores == floor
    wanted = k - above.sum(axis=1, keepdims=True)
    row, column = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= wanted)))
    return scores[row, column].reshape(-1, k), ids[column].reshape(-1, k)


def _search(batches, queries: np.ndarray, terms, k: int) -> Iterator[pa.RecordBatch]:
    best = np.full((len(queries), k), NOTHING, np.int64)
    who = np.zeros((len(queries), k), np.int64)
    for batch in batches:
        all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        matrix = _matrix(batch.column("vector"))
        for start in range(0, len(all_ids), BLOCK_ROWS):
            ids, block = all_ids[start : start + BLOCK_ROWS], matrix[start : start + BLOCK_ROWS]
            order = np.argsort(ids, kind="stable")
            ids, block = ids[order], block[order]
            scores = accumulate(terms, len(queries), block)
            first = np.searchsorted(ids, queries)
            last = np.searchsorted(ids, queries, side="right")
            for q in np.flatnonzero(last > first):
                scores[q, first[q] : last[q]] = NOTHING
            new, new_ids = best_of_block(scores, ids, k)
            both, both_ids = np.hstack([best, new]), np.hstack([who, new_ids])
            ranked = np.lexsort((both_ids, -both), axis=1)[:, :k]
            best = np.take_along_axis(both, ranked, axis=1)
            who = np.take_along_axis(both_ids, ranked, axis=1)
    row, column = np.nonzero(best > NOTHING)
    yield pa.RecordBatch.from_arrays(
        [pa.array(queries[row]), pa.array(who[row, column]), pa.array(best[row, column])],
        names=["query_id", "vec_id", "score"],
    )


def _terms(rows) -> tuple[np.ndarray, list]:
    """Query ids, and for each dimension the queries with a weight there."""
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    width = max((len(r["vector"]) for r in rows), default=0)
    weights = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        weights[i, : len(r["vector"])] = r["vector"]
    at = [np.flatnonzero(column) for column in weights.T]
    return ids, [(rows_, weights[rows_, d]) for d, rows_ in enumerate(at)]


def exact_topk(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best candidates.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vector_col, scale)
    queries = materialize(
        vectors.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries"
    )
    slices = max(1, -(-queries.count() // SLICE_QUERIES))
    search, path = _search, new_dir(spark, "best")
    # One slice after the other, so that one broadcast is held at a time.
    for number in range(slices):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == number).collect()
        shared = spark.sparkContext.broadcast(_terms(chosen))

        def scan(batches, shared=shared):
            ids, terms = shared.value
            return search(batches, ids, terms, k)

        part = vectors.mapInArrow(scan, "query_id long, vec_id long, score long")
        part.write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
