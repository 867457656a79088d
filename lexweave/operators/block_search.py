"""Exact search of many queries over blocks of chunks, pruned by bounds.

Chunks lie in blocks around pivots; a block knows the widest angle between its pivot and its
vectors.  A query within angle t of the pivot has no cosine above ``cos(t - widest)`` in the
block.  Every query first visits the blocks of highest bound until these hold k chunks; its
k-th score there then leaves out every block whose bound is lower.

Both sides meet in one exchange by block: a chunk's vector travels once, a query's as often
as it visits blocks.  A task holds one block of bounded size and streams queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
)

from lexweave.operators.quantize import lloyd, matrix, sample, unit_vector
from lexweave.operators.search import (
    TILE_SCORES,
    _as_vectors,
    _Best,
    _by_length,
    _Queries,
    _row_groups,
)
from lexweave.storage import materialize

# Pivots, which every task holds, and rows they are trained on.
MAX_PIVOTS = 4096
PIVOT_ROWS = 65_536
PIVOT_ROUNDS = 3
# Scores are rounded to nine decimals; a bound this much below the k-th score cannot tie.
SLACK = 1e-8
# Visits, each with its query's vector, in a batch.
VISIT_ROWS = 4096


@dataclass(frozen=True)
class Blocks:
    """Pivots of unit norm; per block its pivot, the length of its vectors, their widest
    angle and their number."""

    pivots: np.ndarray
    pivot: np.ndarray
    length: np.ndarray
    angle: np.ndarray
    rows: np.ndarray

    def bounds(self, vector: np.ndarray) -> np.ndarray:
        """The highest cosine that each block may have with a query.

        Only queries of the blocks' length are bounded: cosines are taken over the common
        length, and zero vectors have no direction."""
        out = np.ones(len(self.pivot))
        size = np.sqrt(vector @ vector)
        if size > 0 and len(vector) == self.pivots.shape[1]:
            cosine = np.clip(self.pivots @ (vector / size), -1.0, 1.0)
            apart = np.arccos(cosine)[self.pivot] - self.angle
            bound = np.cos(np.clip(apart, 0.0, np.pi))
            out = np.where(self.length == len(vector), bound, 1.0)
        return out


def _pivots(left: DataFrame, keys: list[str], vector: str, count: int, width: int) -> np.ndarray:
    units = left.select(*keys, unit_vector(F.col(vector), width).alias("unit"))
    learned = materialize(sample(units, keys, PIVOT_ROWS), "pivot-sample")
    first = learned.orderBy(F.xxhash64(*keys), *keys).limit(count).select("unit").toArrow()
    seeds = matrix(first.column(0).combine_chunks(), width)
    points = learned.select(F.lit(0).alias("group"), F.col("unit").alias("vector"))
    pivots = lloyd(points, seeds[None], PIVOT_ROUNDS)[0]
    size = np.sqrt((pivots**2).sum(axis=1, keepdims=True))
    return np.where(size > 0, pivots / np.where(size > 0, size, 1.0), 0.0)


def _placed(left: DataFrame, vector: str, pivots: np.ndarray, keys: list[str]) -> DataFrame:
    """Chunks with ``pivot``, ``length`` and ``angle``; those that have no direction, or
    another length than the pivots, get the widest angle."""
    width = pivots.shape[1]
    schema = StructType(
        [
            *[left.schema[k] for k in keys],
            StructField("vector", ArrayType(DoubleType())),
            StructField("pivot", IntegerType()),
            StructField("length", IntegerType()),
            StructField("angle", DoubleType()),
        ]
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _as_vectors(batch.column(len(keys)))
            pivot = np.zeros(len(vectors), np.int32)
            angle = np.full(len(vectors), np.pi)
            for rows, block in _by_length(vectors):
                if block.shape[1] != width:
                    continue
                size = np.sqrt((block * block).sum(axis=1))
                rows, block, size = rows[size > 0], block[size > 0], size[size > 0]
                step = max(1, TILE_SCORES // len(pivots))
                for at in range(0, len(rows), step):
                    tile = slice(at, at + step)
                    cosine = block[tile] @ pivots.T / size[tile, None]
                    pivot[rows[tile]] = cosine.argmax(axis=1)
                    nearest = np.clip(cosine.max(axis=1, initial=-1.0), -1.0, 1.0)
                    angle[rows[tile]] = np.arccos(nearest)
            lengths = np.array([len(v) for v in vectors], np.int32)
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = np.concatenate([np.zeros(0), *vectors])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(keys))],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(pivot),
                    pa.array(lengths),
                    pa.array(angle),
                ],
                schema.names,
            )

    return left.select(*keys, vector).mapInArrow(run, schema)


def _blocks(placed: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with their block's number, and a row for each block."""
    group = ["pivot", "length"]
    counts = placed.groupBy(*group).agg(F.count("*").alias("n"))
    slices = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    sliced = placed.join(F.broadcast(counts.select(*group, slices.alias("slices"))), group)
    cut = sliced.withColumn("slice", F.pmod(F.xxhash64(*keys), F.col("slices")).cast("int"))
    facts = (
        cut.groupBy(*group, "slice")
        .agg(F.max("angle").alias("angle"), F.count("*").alias("rows"))
        .orderBy(*group, "slice")
    )
    return cut, facts


def nearest_pruned(
    left: DataFrame,
    queries: DataFrame,
    top_k: int,
    schema: StructType,
    block_rows: int,
) -> tuple[DataFrame, float]:
    """Hits (query id, keys, score), k or more of each query, and the share of (query,
    block) pairs that were pruned.

    ``left`` has the keys and the vector, ``queries`` the id and the vector.
    """
    spark = left.sparkSession
    *keys, vector = left.columns
    query_id, query_vector = queries.columns
    rows = left.count()
    width = left.agg(F.max(F.size(vector))).collect()[0][0] or 0
    if not rows or width < 1:
        width = 1
    count = max(1, min(MAX_PIVOTS, -(-rows // block_rows)))
    pivots = _pivots(left, keys, vector, count, width) if rows else np.zeros((1, width))
    placed = materialize(_placed(left, vector, pivots, keys), "placed-chunks")
    cut, facts = _blocks(placed, keys, block_rows)
    found = facts.toArrow()
    blocks = Blocks(
        pivots, *(found.column(c).to_numpy() for c in ("pivot", "length", "angle", "rows"))
    )
    names = [found.column(c).to_pylist() for c in ("pivot", "length", "slice")]
    numbers = spark.createDataFrame(
        list(zip(*names, range(len(found)), strict=True)),
        "pivot int, length int, slice int, block int",
    )
    chunks = materialize(
        cut.join(F.broadcast(numbers), ["pivot", "length", "slice"]).select(
            "block", *keys, "vector"
        ),
        "blocks",
    )
    asked = materialize(
        queries.select(
            F.col(query_id), F.col(query_vector).cast("array<double>").alias("vector")
        ),
        "asked",
    )

    visits = _visits(asked, blocks, top_k, None)
    first = materialize(_scored(chunks, visits, keys, top_k, schema), "first-hits")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"))
    cutoff = (
        first.withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") == top_k)
        .select(query_id, F.col("score").alias("cutoff"))
    )
    again = asked.join(cutoff, query_id, "left")
    more = materialize(_visits(again, blocks, top_k, "cutoff"), "visits")
    second = _scored(chunks, more, keys, top_k, schema)
    pairs = asked.count() * max(len(blocks.pivot), 1)
    visited = visits.count() + more.count()
    return first.unionByName(second), 1.0 - visited / max(pairs, 1)


def _visits(asked: DataFrame, blocks: Blocks, top_k: int, cutoff: str | None) -> DataFrame:
    """(block, query id, vector): the blocks of highest bound that hold k chunks or, with a
    cutoff, all others whose bound reaches it."""
    schema = StructType(
        [StructField("block", IntegerType()), asked.schema.fields[0], asked.schema["vector"]]
    )

    def visits(batch, who, where):
        block = np.concatenate([np.zeros(0, np.int64), *where]).astype(np.int32)
        query = np.repeat(np.array(who, np.int64), [len(w) for w in where])
        for start in range(0, len(block), VISIT_ROWS):
            at = pa.array(query[start : start + VISIT_ROWS])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[start : start + VISIT_ROWS]),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                ],
                schema.names,
            )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _as_vectors(batch.column(1))
            floors = batch.column(2).to_pylist() if cutoff else [None] * len(vectors)
            who, where, held = [], [], 0
            for i, (vector, floor) in enumerate(zip(vectors, floors, strict=True)):
                bounds = blocks.bounds(vector)
                order = np.argsort(-bounds, kind="stable")
                first = int(np.searchsorted(np.cumsum(blocks.rows[order]), top_k)) + 1
                chosen = order[:first]
                if cutoff:
                    rest = order[first:]
                    chosen = rest if floor is None else rest[bounds[rest] >= floor - SLACK]
                who.append(i)
                where.append(chosen)
                held += len(chosen)
                if held >= VISIT_ROWS:
                    yield from visits(batch, who, where)
                    who, where, held = [], [], 0
            yield from visits(batch, who, where)

    return asked.mapInArrow(run, schema)


def _scored(
    chunks: DataFrame, visits: DataFrame, keys: Sequence[str], top_k: int, schema: StructType
) -> DataFrame:
    """The best k of each visited block for each visit."""
    query_id = schema.names[0]
    id_type = visits.schema[query_id].dataType
    none = [F.lit(None).cast(chunks.schema[k].dataType).alias(k) for k in keys]
    both = chunks.select(
        "block", F.lit(0).alias("side"), F.lit(None).cast(id_type).alias(query_id), *keys, "vector"
    ).unionByName(
        visits.select("block", F.lit(1).alias("side"), query_id, *none, "vector")
    )
    n = len(keys)
    dealt = both.repartition("block").sortWithinPartitions("block", "side")

    def run(batches) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if place[a] // 2 != block:
                    block, held, ready = place[a] // 2, [], None
                if place[a] % 2 == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ready = (
                        [table.column(3 + i).combine_chunks() for i in range(n)],
                        _row_groups(table.column(3 + n)),
                        [table.schema.field(3 + i) for i in range(n)],
                    )
                ids = part.column(2)
                asked = _Queries(ids.to_pylist(), ids.type, _as_vectors(part.column(3 + n)))
                best = _Best(asked, top_k)
                best.add(ready[0], ready[1])
                yield best.table(ready[2], query_id)

    return dealt.mapInArrow(run, schema)
