"""Quantisers of vectors, trained by Lloyd's rounds as Spark jobs.

Every round assigns points to their nearest centroid in tasks, which send sums by centroid;
only centroids come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.chunking import let
from lexweave.functions.vectors import norm, normalize_vector

# Rows a quantiser is trained on at most, chosen by a hash of their keys.
TRAIN_ROWS = 65_536
ROUNDS = 8
# Products of points and centroids held at a time.
TILE_PRODUCTS = 1 << 21
_SUMS = "place int, dimension int, total double, points long"


def unit_vector(vector: Column, dimensions: int) -> Column:
    """A vector of fixed length and unit norm; missing ones, and null, are zeros."""
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    padded = F.slice(F.concat(normalize_vector(vector), zeros), 1, dimensions)
    return let(
        padded,
        lambda v: let(
            norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))
        ),
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


def nearest_place(points: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of each point's nearest centroid among those of its group.

    ``centroids`` is (group, code, dimension); the number counts codes of all groups."""
    out = np.zeros(len(points), np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(centroids) + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[g] : cuts[g + 1]]
        half = 0.5 * (centroids[g] ** 2).sum(axis=1)
        step = max(1, TILE_PRODUCTS // len(half))
        for start in range(0, len(rows), step):
            tile = rows[start : start + step]
            near = points[tile] @ centroids[g].T - half
            out[tile] = g * centroids.shape[1] + near.argmax(axis=1)
    return out


def lloyd(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (group, code, dimension) after some rounds over ``points``: rows of
    (group, vector), a vector holding one or several points one after the other; several
    belong to as many groups, from the row's on.  A centroid without points stays."""
    groups, codes, width = centroids.shape

    def sums(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups * codes, width))
        count = np.zeros(groups * codes, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            parts = len(flat) // batch.num_rows // width
            first = batch.column(0).to_numpy(zero_copy_only=False)
            group = (first[:, None] + np.arange(parts)).ravel()
            rows = flat.reshape(-1, width)
            place = nearest_place(rows, centroids, group)
            for d in range(width):
                total[:, d] += np.bincount(place, rows[:, d], groups * codes)
            count += np.bincount(place, minlength=groups * codes)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array(total[used].ravel()),
                pa.array(np.repeat(count[used], width)),
            ],
            ["place", "dimension", "total", "points"],
        )

    for _ in range(rounds):
        found = (
            points.select("group", "vector")
            .mapInArrow(sums, _SUMS)
            .groupBy("place", "dimension")
            .agg((F.sum("total") / F.sum("points")).alias("mean"))
            .toArrow()
        )
        flat = centroids.reshape(groups * codes, width).copy()
        place, dimension, mean = (found.column(i).to_numpy() for i in range(3))
        flat[place, dimension] = mean
        centroids = flat.reshape(centroids.shape)
    return centroids


@dataclass(frozen=True)
class Quantizer:
    """Centroids of lists (list, dimension), and codebooks of residuals (part, code,
    dimension of a part)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return nearest_place(vectors, self.centroids[None], np.zeros(len(vectors), np.int64))

    def codes_of(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """One byte for each part of the residual."""
        parts, codes, width = self.codebooks.shape
        residual = (vectors - self.centroids[lists]).reshape(-1, width)
        group = np.tile(np.arange(parts), len(vectors))
        place = nearest_place(residual, self.codebooks, group)
        return (place % codes).astype(np.uint8).reshape(len(vectors), parts)


def sample(vectors: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of their keys; all, if there are fewer."""
    share = rows / max(vectors.count(), 1)
    if share >= 1:
        return vectors
    return vectors.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(share * (1 << 20)))


def train(
    vectors: DataFrame,
    keys: list[str],
    lists: int,
    parts: int,
    codes: int = 16,
    rows: int = TRAIN_ROWS,
    rounds: int = ROUNDS,
) -> Quantizer:
    """Learn from about ``rows`` rows of (keys, ``unit``), whose vectors have one length."""
    if codes > 256:
        raise ValueError("a code is one byte")
    learned = sample(vectors, keys, rows)
    first = learned.orderBy(F.xxhash64(*keys), *keys).limit(max(lists, codes))
    seeds = first.select("unit").toArrow().column(0).combine_chunks()
    if not len(seeds):
        raise ValueError("no vectors to learn from")
    width = len(seeds[0])
    known = matrix(seeds, width)
    start = known[np.arange(lists) % len(known)]
    group = F.lit(0).alias("group")
    centroids = lloyd(learned.select(group, F.col("unit").alias("vector")), start[None], rounds)[0]

    coarse = Quantizer(centroids, np.zeros((parts, 1, width // parts)))

    def residuals(batches):
        for batch in batches:
            unit = matrix(batch.column(0), width)
            apart = unit - centroids[coarse.lists_of(unit)]
            ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(unit)), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(apart.ravel())),
                ],
                ["group", "vector"],
            )

    apart = learned.select("unit").mapInArrow(residuals, "group int, vector array<double>")
    seeds = known - centroids[coarse.lists_of(known)]
    start = seeds[np.arange(codes) % len(seeds)].reshape(codes, parts, -1).swapaxes(0, 1)
    return Quantizer(centroids, lloyd(apart, np.ascontiguousarray(start), rounds))
