"""Exact and approximate nearest-neighbour search.

A single query is a scored projection and a top-k.  A batch of queries is scored
block-wise: each task multiplies Arrow batches of chunk vectors with the query
matrix, keeps the best k per query, and only those rows leave the task.  No
(query, chunk) pair is materialised.

Scores are cosine similarities rounded to nine decimals; equal scores are
ordered by the chunk keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexweave.functions.vectors import (
    SCORE_DECIMALS,
    cosine_distance,
    cosine_similarity,
    dot,
    normalize_vector,
    rounded_score,
)

DEFAULT_TOP_K = 5

# Queries shipped to every task.  More than this many are joined in blocks: pruned by bounds
# (``block_search``), or all with all within an approximate index.
MAX_SHIPPED_QUERIES = 2048
# Size of a block of chunks, and bytes in a block of queries, in that join.
BLOCK_ROWS = 8192
QUERY_BLOCK_BYTES = 32 << 20
# Scores held at a time in a task.
TILE_SCORES = 1 << 21
# Result keys broadcast to fetch the other columns of the winning rows.
MAX_BROADCAST_HITS = 200_000

# Approximate index: buckets are numbered by this many signature bits, and a query
# probes this share of them, those it would fall in with the least change.
SIGNATURE_BITS = 8
PROBED_SHARE = 0.375

CHUNK_KEYS = ("chunk_uid", "chunk_id")

_RESULT_COLUMNS = (
    "chunk_uid",
    "document_id",
    "file_name",
    "chunk_id",
    "page_number",
    "article_number",
    "title",
    "chunk_text",
    "char_length",
    "regulation_family",
    "source_name",
    "source_path",
)


def check_top_k(top_k: int, maximum: int | None = None) -> int:
    if top_k <= 0 or (maximum is not None and top_k > maximum):
        limit = f"1..{maximum}" if maximum else "> 0"
        raise ValueError(f"top_k must be {limit}, got {top_k}")
    return top_k


# -- one query ---------------------------------------------------------------


def score_chunks(
    chunks: DataFrame, query_vector: Column, vector: str = "embedding"
) -> DataFrame:
    """Every chunk with its score and distance to one query vector, which may be a
    scalar subquery."""
    score = rounded_score(cosine_similarity(F.col("_query"), F.col(vector)))
    return (
        chunks.withColumn("_query", query_vector)
        .withColumn("score", score)
        .withColumn("distance", cosine_distance(F.col("score")))
        .drop("_query")
    )


def top_k_single(
    scored: DataFrame, top_k: int = DEFAULT_TOP_K, keys: Sequence[str] = CHUNK_KEYS
) -> DataFrame:
    check_top_k(top_k)
    return scored.orderBy(F.col("score").desc(), *keys).limit(top_k)


# -- many queries ------------------------------------------------------------


def numbered_results(
    results: DataFrame, keys: Sequence[str] = CHUNK_KEYS, query_id: str = "query_id"
) -> DataFrame:
    """1-based rank of each row within its query's results."""
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *keys)
    return results.withColumn("rank", F.row_number().over(order))


@dataclass(frozen=True)
class _Queries:
    """Query vectors as they are shipped to tasks, and the buckets each one probes."""

    ids: list
    id_type: pa.DataType
    vectors: list[np.ndarray]
    probes: np.ndarray | None = None


def _as_vectors(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Vectors as doubles; null vectors are empty and null elements dropped."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0:
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return [
        np.array([x for x in (vector or ()) if x is not None], dtype=np.float64)
        for vector in column.to_pylist()
    ]


def _row_groups(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``_by_length`` straight from the buffers, without an object for each vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if column.null_count or flat.null_count:
        return _by_length(_as_vectors(column))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    lengths, groups = np.diff(offsets), []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if len(rows) == len(lengths):
            groups.append((rows, values.reshape(len(rows), n)))
        else:
            groups.append((rows, values[offsets[rows][:, None] + np.arange(n)]))
    return groups


def _by_length(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each distinct vector length."""
    lengths = np.array([len(v) for v in vectors], dtype=np.int64)
    return [
        (rows, np.stack([vectors[i] for i in rows]))
        for rows in (np.flatnonzero(lengths == n) for n in np.unique(lengths))
    ]


def _cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    width = min(rows.shape[1], queries.shape[1])
    if width == 0:
        return np.zeros((len(rows), len(queries)))
    a, b = rows[:, :width], queries[:, :width]
    scale = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.where(scale > 0, (a @ b.T) / scale, 0.0)
    return np.round(scores, SCORE_DECIMALS) + 0.0


class _Best:
    """The best k rows per query over the blocks seen so far."""

    def __init__(self, queries: _Queries, k: int):
        self.queries = queries
        self.k = k
        self.groups = _by_length(queries.vectors)
        self.rows: list[list[tuple]] = [[] for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf)

    def add(self, keys: list[pa.Array], groups, buckets=None) -> None:
        """``groups`` holds (row numbers, matrix) for each length of vectors."""
        self.place = None
        for row_ids, matrix in groups:
            for query_ids, query_matrix in self.groups:
                if buckets is None:
                    self._add_block(keys, row_ids, matrix, query_ids, query_matrix)
                    continue
                row_buckets = buckets[row_ids]
                for bucket in np.unique(row_buckets):
                    near = self.queries.probes[query_ids, bucket]
                    here = row_buckets == bucket
                    if near.any():
                        self._add_block(
                            keys, row_ids[here], matrix[here], query_ids[near], query_matrix[near]
                        )

    def _add_block(self, keys, row_ids, matrix, query_ids, query_matrix) -> None:
        rows = max(1, TILE_SCORES // len(query_ids))
        for start in range(0, len(row_ids), rows):
            tile = slice(start, start + rows)
            self._add_tile(keys, row_ids[tile], matrix[tile], query_ids, query_matrix)

    def _add_tile(self, keys, row_ids, matrix, query_ids, query_matrix) -> None:
        scores = _cosines(matrix, query_matrix)
        for column in np.flatnonzero(scores.max(axis=0) >= self.floor[query_ids]):
            query = query_ids[column]
            found = scores[:, column]
            cut = self.floor[query]
            if len(found) > self.k:
                kth = len(found) - self.k
                cut = max(cut, np.partition(found, kth)[kth])
            hits = np.flatnonzero(found >= cut)
            if len(hits) > self.k:
                hits = self._smallest_keys(keys, row_ids, found, hits, cut)
            entries = [
                (-found[i], *(key[int(row_ids[i])].as_py() for key in keys)) for i in hits
            ]
            best = sorted(self.rows[query] + entries)[: self.k]
            self.rows[query] = best
            if len(best) == self.k:
                self.floor[query] = -best[-1][0]

    def _smallest_keys(self, keys, row_ids, found, hits, cut) -> np.ndarray:
        """The hits above the cut, and of those at it as many with the smallest keys."""
        if self.place is None:
            names = [str(i) for i in range(len(keys))]
            order = pc.sort_indices(
                pa.table(dict(zip(names, keys))), sort_keys=[(n, "ascending") for n in names]
            ).to_numpy()
            self.place = np.empty(len(order), np.int64)
            self.place[order] = np.arange(len(order))
        above, ties = hits[found[hits] > cut], hits[found[hits] == cut]
        wanted = self.k - len(above)
        if wanted < len(ties):
            ties = ties[np.argpartition(self.place[row_ids[ties]], wanted)[:wanted]]
        return np.concatenate([above, ties])

    def table(self, key_fields: list[pa.Field], id_name: str) -> pa.RecordBatch:
        flat = [
            (query_id, row)
            for query_id, rows in zip(self.queries.ids, self.rows)
            for row in rows
        ]
        columns = [pa.array([q for q, _ in flat], self.queries.id_type)]
        for position, field in enumerate(key_fields, start=1):
            columns.append(pa.array([row[position] for _, row in flat], field.type))
        columns.append(pa.array([-row[0] + 0.0 for _, row in flat], pa.float64()))
        names = [id_name, *(f.name for f in key_fields), "score"]
        return pa.RecordBatch.from_arrays(columns, names)


@dataclass(frozen=True)
class Buckets:
    """The bucket column of an approximate index, and how a query chooses buckets."""

    column: str
    dimensions: int
    bits: int = SIGNATURE_BITS
    probed_share: float = PROBED_SHARE

    def planes(self) -> np.ndarray:
        """Fixed hyperplanes, one row of signs per bit."""
        return np.array(
            [
                [
                    1.0 if int(hashlib.md5(f"{h}:{d}".encode()).hexdigest()[0], 16) < 8 else -1.0
                    for d in range(self.dimensions)
                ]
                for h in range(self.bits)
            ]
        )

    def probes(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Per query, which buckets it probes: those whose differing bits lie on
        planes that the query is closest to."""
        planes = self.planes()
        codes = np.arange(1 << self.bits)
        bits = (codes[:, None] >> np.arange(self.bits)) & 1
        wanted = max(1, int(len(codes) * self.probed_share))
        out = np.zeros((len(vectors), len(codes)), dtype=bool)
        for i, vector in enumerate(vectors):
            margins = planes[:, : len(vector)] @ vector[: self.dimensions]
            cost = (np.abs(margins) * (bits != (margins > 0))).sum(axis=1)
            out[i, np.argsort(cost, kind="stable")[:wanted]] = True
        return out


def _queries_of(table: pa.Table, buckets: Buckets | None) -> _Queries:
    vectors = _as_vectors(table.column(1))
    probes = buckets.probes(vectors) if buckets else None
    return _Queries(table.column(0).to_pylist(), table.schema.field(0).type, vectors, probes)


def nearest(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    *,
    keys: Sequence[str] = CHUNK_KEYS,
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    buckets: Buckets | None = None,
    max_shipped: int = MAX_SHIPPED_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The top k chunk keys of every query, as (query id, keys, score, rank).

    ``keys`` must identify a chunk.  With ``buckets`` only chunks in the buckets
    that a query probes are scored (approximate search).  A result of proven small
    size carries a broadcast hint for the join that fetches further columns.
    """
    check_top_k(top_k)
    wanted = queries.select(query_id, query_vector)
    fields = [chunks.schema[k] for k in keys]
    schema = StructType(
        [queries.schema[query_id], *fields, StructField("score", DoubleType())]
    )
    left = chunks.select(*keys, vector, *([buckets.column] if buckets else []))

    head = wanted.limit(max_shipped + 1).toArrow()
    shipped = head.num_rows <= max_shipped
    if shipped:
        best = _nearest_shipped(
            left, _queries_of(head, buckets), top_k, schema, query_id, buckets
        )
    elif buckets is None:
        from lexweave.operators.block_search import nearest_pruned

        best, _ = nearest_pruned(left, wanted, top_k, schema, block_rows)
    else:
        width = max(len(v) for v in _as_vectors(head.column(1)))
        query_rows = min(4 * block_rows, QUERY_BLOCK_BYTES // (8 * max(width, 1)))
        best = _nearest_blocks(
            left, wanted, top_k, schema, query_id, buckets, (block_rows, max(query_rows, 1))
        )
    hits = numbered_results(best, keys, query_id).where(F.col("rank") <= top_k)
    if shipped and head.num_rows * top_k <= MAX_BROADCAST_HITS:
        return F.broadcast(hits)
    return hits


def _nearest_shipped(
    left: DataFrame,
    queries: _Queries,
    top_k: int,
    schema: StructType,
    query_id: str,
    buckets: Buckets | None,
) -> DataFrame:
    n_keys = len(schema.fields) - 2
    if buckets is not None:
        probed = np.flatnonzero(queries.probes.any(axis=0))
        left = left.where(F.col(buckets.column).isin([int(b) for b in probed]))

    # Plain values, which workers can load without this module.
    shared = left.sparkSession.sparkContext.broadcast(
        (queries.ids, queries.id_type, queries.vectors, queries.probes)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key_fields = _Best(_Queries(*shared.value), top_k), None
        for batch in batches:
            key_fields = [batch.schema.field(i) for i in range(n_keys)]
            if batch.num_rows and best.queries.ids:
                best.add(
                    [batch.column(i) for i in range(n_keys)],
                    _row_groups(batch.column(n_keys)),
                    None if buckets is None else batch.column(n_keys + 1).to_numpy(),
                )
        if key_fields is not None:
            yield best.table(key_fields, query_id)

    return left.mapInArrow(run, schema)


def _nearest_blocks(
    left: DataFrame,
    queries: DataFrame,
    top_k: int,
    schema: StructType,
    query_id: str,
    buckets: Buckets | None,
    block_rows: tuple[int, int],
) -> DataFrame:
    """Block join: both sides are hashed into blocks of bounded size, and each task
    sees one block of chunks and one block of queries."""
    n_keys = len(schema.fields) - 2
    keys = left.columns[:n_keys]
    row_blocks = -(-left.count() // block_rows[0]) or 1
    query_blocks = -(-queries.count() // block_rows[1]) or 1

    def block(columns: Sequence[str], blocks: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")

    def all_blocks(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    rows = left.withColumn("_rows", block(keys, row_blocks)).withColumn(
        "_queries", all_blocks(query_blocks)
    )
    asked = queries.withColumn("_queries", block([query_id], query_blocks)).withColumn(
        "_rows", all_blocks(row_blocks)
    )

    def run(row_table: pa.Table, query_table: pa.Table) -> pa.Table:
        key_fields = [row_table.schema.field(i) for i in range(n_keys)]
        best = _Best(_queries_of(query_table, buckets), top_k)
        if row_table.num_rows and query_table.num_rows:
            best.add(
                [row_table.column(i).combine_chunks() for i in range(n_keys)],
                _row_groups(row_table.column(n_keys)),
                row_table.column(n_keys + 1).to_numpy() if buckets else None,
            )
        return pa.Table.from_batches([best.table(key_fields, query_id)])

    return (
        rows.groupBy("_rows", "_queries")
        .cogroup(asked.groupBy("_rows", "_queries"))
        .applyInArrow(run, schema)
    )


def vector_search(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    *,
    keys: Sequence[str] = CHUNK_KEYS,
    **options,
) -> DataFrame:
    """Top k chunks of every query with all chunk columns but the vector.

    Only keys and vectors are read for scoring; the other columns are fetched
    for the winning rows.
    """
    vector = options.get("vector", "embedding")
    winners = nearest(chunks, queries, top_k, keys=keys, **options)
    return winners.join(chunks.drop(vector), list(keys)).withColumn(
        "distance", cosine_distance(F.col("score"))
    )


# -- approximate search ------------------------------------------------------


def with_bucket(df: DataFrame, vector: str, buckets: Buckets) -> DataFrame:
    """The frame with its bucket number: one bit per plane, set on its positive side."""
    values = normalize_vector(F.col(vector))

    def side(bit: int, signs: np.ndarray) -> Column:
        positive = dot(F.col("_values"), F.array(*[F.lit(float(s)) for s in signs])) > 0
        return F.when(positive, F.lit(1 << bit)).otherwise(F.lit(0))

    total = sum(
        (side(bit, signs) for bit, signs in enumerate(buckets.planes())), F.lit(0)
    )
    return (
        df.withColumn("_values", values)
        .withColumn(buckets.column, total.cast("int"))
        .drop("_values")
    )


def write_ann_index(
    df: DataFrame, vector: str, buckets: Buckets, path: str, keys: Sequence[str] = CHUNK_KEYS
) -> DataFrame:
    """Write vectors sorted by bucket, so that a search skips the row groups of
    buckets it does not probe.  Range partitioning by bucket and key also splits a
    bucket that holds a large share of the rows."""
    bucketed = with_bucket(df, vector, buckets)
    (
        bucketed.repartitionByRange(buckets.column, *keys)
        .sortWithinPartitions(buckets.column)
        .write.parquet(path)
    )
    return df.sparkSession.read.schema(bucketed.schema).parquet(path)


def ann_search(
    indexed: DataFrame,
    queries: DataFrame,
    buckets: Buckets,
    top_k: int = DEFAULT_TOP_K,
    **options,
) -> DataFrame:
    """Approximate top k: exact scores, but only within the probed buckets."""
    return nearest(indexed, queries, top_k, buckets=buckets, **options)


# -- result shapes -----------------------------------------------------------


def index_projection(embedded: DataFrame) -> DataFrame:
    """The columns a search reads."""
    return embedded.select(*_RESULT_COLUMNS, "embedding")


def search_rows(results: DataFrame) -> DataFrame:
    """Result rows under the names that readers expect, details in ``metadata``."""
    return results.select(
        *[c for c in ("query_id", "rank") if c in results.columns],
        "chunk_uid",
        "article_number",
        "title",
        "regulation_family",
        F.col("file_name").alias("source_file"),
        F.col("page_number").alias("page"),
        F.col("chunk_text").alias("text"),
        "score",
        "distance",
        F.struct(
            "document_id",
            "file_name",
            "chunk_id",
            "page_number",
            "char_length",
            "source_name",
            "source_path",
        ).alias("metadata"),
    )


def result_records(results: DataFrame) -> DataFrame:
    """Result rows as (query, rank, label, content, metadata, distance)."""
    return results.select(
        "query_id",
        "rank",
        "chunk_uid",
        F.col("chunk_text").alias("content"),
        F.struct(
            F.col("file_name").alias("source_file"),
            "regulation_title",
            "document_version",
            "article_number",
            "annex_number",
            F.col("page_number").alias("page"),
            "part_index",
            "part_count",
            F.col("chunk_type").alias("type"),
            "title",
        ).alias("metadata"),
        "distance",
    )


def encode_nulls(chunks: DataFrame, *extra: str) -> DataFrame:
    """Chunk metadata for stores without nulls: -1 for the page, '' for texts."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return chunks.select(
        "chunk_uid",
        F.col("file_name").alias("source_file"),
        F.coalesce("page_number", F.lit(-1)).alias("page_number"),
        F.col("chunk_id").alias("chunk_index"),
        F.col("chunk_type").alias("type"),
        text("article_number"),
        text("annex_number"),
        text("title"),
        "part_index",
        "part_count",
        text("law_passed_date"),
        # Chunks that were not yet stored have no time.
        text("ingested_at") if "ingested_at" in chunks.columns else F.lit("").alias("ingested_at"),
        *[
            text(name)
            for name in (
                "regulation_title",
                "document_version",
                "issuing_authority",
            )
        ],
        *extra,
    )
