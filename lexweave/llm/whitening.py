"""Whitening of vectors on the leading components of their covariance.

Vectors become integers, ``floor(scale * c) + offset``.  Sums and products are exact: tasks
add up blocks in integers, Spark adds up the tasks' rows by (dimension, dimension), and the
covariance is centred twice, by the rounded mean before multiplying and by the exact rest
after.  Only this matrix, of the width of a vector squared, comes to the driver, where
contour integration finds its components (``feast``).

Vectors that are null or hold null or non-finite entries are dropped.  Missing dimensions
count as 0.  Rows repeat as they come and null ids stay.  Vectors whose entries are further
than 2^31 from the rounded mean end the job, as their products would not be exact; a
deviation beyond 38 digits does so too.  An empty table gives no rows and equal vectors no
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.llm import feast
from lexweave.llm.tables import passing, record
from lexweave.storage import materialize

BLOCK_ROWS = 4096
# Products are exact in doubles below 2^53 and in long integers below 2^63.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62
WIDEST = 1 << 31


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is complete and finite."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(
        vector.cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return df.where(vector.isNotNull() & finite)


def _matrix(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """``floor(scale * c)`` of each vector, as doubles, which hold it exactly."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _blocks(batches, vector_col: str, scale: int, centre: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of integers less the centre."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield _centred(_matrix(part.column(vector_col), scale, len(centre)), centre)


def _centred(matrix: np.ndarray, centre: np.ndarray) -> np.ndarray:
    if np.abs(matrix).max(initial=0.0) >= EXACT_DOUBLE:
        raise ArithmeticError("entries too large for exact sums")
    z = matrix.astype(np.int64) - centre
    if np.abs(z).max(initial=0) >= WIDEST:
        raise ArithmeticError("entries too far from the mean for exact products")
    return z


def _sums(vectors: DataFrame, scale: int, width: int) -> tuple[int, list[int]]:
    """The number of rows, and the sum of each dimension without offset."""

    def add_up(batches):
        # The first pass knows no mean; rows are few enough in a block to add up exactly.
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = _matrix(batch.column(0).slice(start, BLOCK_ROWS), scale, width)
                if np.abs(block).max(initial=0.0) * len(block) >= EXACT_LONG:
                    raise ArithmeticError("entries too large for exact sums")
                total = block.astype(np.int64).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width), pa.int32()), pa.array(total)], ["i", "total"]
                )

    parts = vectors.mapInArrow(add_up, "i int, total long")
    rows = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = {r["i"]: int(r["total"]) for r in rows.collect()}
    return vectors.count(), [sums[i] for i in range(width)]


def _products(vectors: DataFrame, scale: int, centre: np.ndarray) -> np.ndarray:
    """Sums of products of centred dimensions, as Python integers."""
    upper = np.triu_indices(len(centre))
    name = vectors.columns[0]

    def flushed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(upper[0], pa.int32()),
                pa.array(upper[1], pa.int32()),
                pa.array(total[upper], pa.int64()),
            ],
            ["i", "j", "total"],
        )

    def add_up(batches):
        total = np.zeros((len(centre), len(centre)), np.int64)
        bound = 0
        for z in _blocks(batches, name, scale, centre):
            most = max(int(np.abs(z).max(initial=0)) ** 2, 1)
            rows = max(1, min(len(z), EXACT_LONG // most))
            for start in range(0, len(z), rows):
                part = z[start : start + rows]
                if bound + most * len(part) > EXACT_LONG:
                    yield flushed(total)
                    total, bound = np.zeros_like(total), 0
                if most * len(part) < EXACT_DOUBLE:
                    real = part.astype(np.float64)
                    total += (real.T @ real).astype(np.int64)
                else:
                    total += part.T @ part
                bound += most * len(part)
        if bound:
            yield flushed(total)

    parts = vectors.mapInArrow(add_up, "i int, j int, total long")
    rows = (
        parts.groupBy("i", "j")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    out = np.zeros((len(centre), len(centre)), object)
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["total"])
    return out


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: the exact mean as a rounded centre and the rest of the sums, and
    the components in columns with their variances and shares of all variance."""

    scale: int
    offset: int
    n: int
    centre: np.ndarray
    rest: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def fit(
    df: DataFrame,
    components: int,
    vector_col: str = "embedding",
    scale: int = 1024,
    offset: int = 100_000,
) -> Whitening:
    """Learn from all usable vectors."""
    vectors = usable(df, vector_col).select(
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    width = vectors.agg(F.max(F.size("vector"))).collect()[0][0] or 0
    if not width:
        none = np.zeros(0)
        return Whitening(
            scale, offset, vectors.count(), np.zeros(0, np.int64), [], np.zeros((0, 0)), none, none
        )
    n, sums = _sums(vectors, scale, width)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    centre = np.array(middle, np.int64)
    products = _products(vectors, scale, centre)
    # Integers divided once, hence correct to the last digit.
    exact = [
        [(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(width)]
        for i in range(width)
    ]
    covariance = np.array(exact, np.float64)
    variances, found = feast.largest(covariance, components)
    explained = variances / np.trace(covariance) if len(variances) else variances
    return Whitening(scale, offset, n, centre, rest, found, variances, explained)


def _whitened(z: np.ndarray, model: Whitening) -> np.ndarray:
    rest = np.array([r / model.n for r in model.rest])
    return (z - rest) @ (model.components / np.sqrt(model.variances))


def _deviation(z: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of ``(n * x - S)^2``, exactly."""
    n = model.n
    most = int(np.abs(z).max(initial=0)) + 1
    if 4 * (n * most) ** 2 * max(z.shape[1], 1) < EXACT_LONG:
        y = n * z - np.array(model.rest, np.int64)
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    y = z.astype(object) * n - np.array(model.rest, object)
    return pa.array([Decimal(int(v)) for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))


def whiten(
    df: DataFrame, model: Whitening, vector_col: str = "embedding", keep: list[str] | None = None
) -> DataFrame:
    """The usable rows with ``whitened``, the vector on each component over the root of its
    variance, and ``deviation``, the exact sum over dimensions of ``(n * x - S)^2``.

    Columns with these names give way; ``keep`` names the others to return.
    """
    added = [
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
        T.StructField("deviation", T.DecimalType(38, 0)),
    ]
    chosen, names, schema = passing(usable(df, vector_col), keep, added, [vector_col])
    arrow = to_arrow_schema(schema)

    def project(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                vectors = part.column(vector_col)
                z = _centred(_matrix(vectors, model.scale, len(model.centre)), model.centre)
                values = _whitened(z, model)
                ends = np.arange(len(z) + 1, dtype=np.int32) * values.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
                yield record(part, names, [lists, _deviation(z, model)], arrow)

    return chosen.mapInArrow(project, schema)


def covariance(df: DataFrame, vector_col: str = "whitened") -> np.ndarray:
    """Covariance of vectors of one length, divisor n; centred by task, then by the mean."""
    schema = "i int, j int, n long, a double, b double, total double"

    def scatter(batches):
        count, mean, total = 0, 0.0, 0.0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            block = flat.reshape(batch.num_rows, -1)
            middle = block.mean(axis=0)
            apart = block - middle
            both = count + len(block)
            shift = middle - mean
            total = total + apart.T @ apart + np.outer(shift, shift) * (count * len(block) / both)
            mean = mean + shift * (len(block) / both)
            count = both
        if count:
            i, j = np.indices(total.shape).reshape(2, -1)
            columns = [i, j, np.full(len(i), count), mean[i], mean[j], total.ravel()]
            types = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "n", "a", "b", "total"])

    parts = materialize(df.select(F.col(f"`{vector_col}`")).mapInArrow(scatter, schema), "scatter")
    means = parts.groupBy("i", "j").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("mean_a"),
        (F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("mean_b"),
    )
    apart = F.col("n") * (F.col("a") - F.col("mean_a")) * (F.col("b") - F.col("mean_b"))
    rows = (
        parts.join(F.broadcast(means), ["i", "j"])
        .groupBy("i", "j")
        .agg((F.sum(F.col("total") + apart) / F.first("rows")).alias("value"))
        .collect()
    )
    width = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((width, width))
    for r in rows:
        out[r["i"], r["j"]] = r["value"]
    return out


def whitened_components(
    df: DataFrame,
    components: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    **options,
) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation,
    whitened, explained (the component's share of the variance) and identity_error (how far
    the covariance of ``whitened`` is from the identity)."""
    model = fit(df, components, vector_col, **options)
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_col}`").alias("vector"),
    )
    flat = whiten(rows, model, "vector", keep=["vec_id"])
    found = covariance(flat)
    error = float(np.abs(found - np.eye(len(found))).max(initial=0.0))
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return flat.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
