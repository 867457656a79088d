"""Approximate search by inverted lists with residual codes, kept up by deltas.

Every vector lies in the list of its nearest centroid and has a code of a few bytes for the
rest.  A query reads the codes of the lists nearest to it, takes the ``survivors`` best by
the codes, and scores these, and only these, exactly.

Lists are buckets of a ``Versions`` table.  An upsert adds files to the lists of the new rows
and a tombstone for each key: rows of the key from before that version are dead.  When dead
rows or files become many, ``maintain`` writes the lists concerned anew, and splits lists
that have outgrown a bound.

Vectors are compared by direction; null and empty ones count as zeros, which score 0.  Scores
that agree to nine decimals are ties and ordered by key, as in exact search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from lexweave.functions.vectors import SCORE_DECIMALS, dot, norm
from lexweave.operators.quantize import (
    TRAIN_ROWS,
    Quantizer,
    lloyd,
    matrix,
    train,
    unit_vector,
)
from lexweave.operators.rows import small_side
from lexweave.operators.search import CHUNK_KEYS, DEFAULT_TOP_K, check_top_k, numbered_results
from lexweave.sinks.versions import FILES_PER_BUCKET, Manifest, Versions, empty_table
from lexweave.storage import materialize

LISTS, DEAD, CENTROIDS, CODEBOOKS = "lists", "dead", "centroids", "codebooks"

# Of the lists those nearest to a query that hold this share of the rows are read; codes
# are a sixteenth of a vector of doubles.
PROBED_SHARE = 0.75
# Rows scored exactly for each row of the result, but at most this share of all rows.
SURVIVORS_PER_RESULT, SURVIVING_SHARE = 40, 0.1
# Queries sent to every task at a time.
MAX_SHIPPED_QUERIES = 2048
# Codes of a list that meet the queries at a time, and scores of these at most.
SLICE_ROWS = 1 << 16
SLICE_SCORES = 1 << 21
# Lists are written anew when this share of all rows is dead.
DEAD_SHARE = 0.1


@dataclass(frozen=True)
class ListIndex:
    """An index under a folder, and the columns that identify a vector."""

    root: str
    keys: tuple[str, ...] = CHUNK_KEYS
    vector: str = "embedding"

    def versions(self, spark: SparkSession) -> Versions:
        return Versions(spark, self.root)


def _encoded(rows: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Rows with ``list`` and ``code`` behind their columns; reads ``unit``."""
    schema = StructType(
        [*rows.schema.fields, StructField("list", IntegerType()), StructField("code", BinaryType())]
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = matrix(batch.column("unit"), quantizer.dimensions)
            lists = quantizer.lists_of(unit)
            codes = [row.tobytes() for row in quantizer.codes_of(unit, lists)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.int32()), pa.array(codes, pa.binary())],
                [*batch.schema.names, "list", "code"],
            )

    return rows.mapInArrow(run, schema)


def _units(rows: DataFrame, index: ListIndex, dimensions: int) -> DataFrame:
    unit = unit_vector(F.col(index.vector), dimensions).cast("array<float>")
    return rows.select(*index.keys, unit.alias("unit"))


def _list_rows(rows: DataFrame, index: ListIndex, quantizer: Quantizer, version: int) -> DataFrame:
    units = _units(rows, index, quantizer.dimensions)
    return _encoded(units, quantizer).withColumn("version", F.lit(version).cast("long"))


def _matrix_rows(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """A matrix as rows of (place, vector)."""
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(values)]
    return spark.createDataFrame(rows, "place int, vector array<double>")


def _matrix_of(rows: DataFrame) -> np.ndarray:
    found = rows.orderBy("place").select("vector").toArrow().column(0).combine_chunks()
    return matrix(found, len(found[0]))


def _with_quantizer(versions: Versions, tables: dict, folder: str, quantizer: Quantizer) -> dict:
    parts, codes, width = quantizer.codebooks.shape
    out = dict(tables)
    for name, values in (
        (CENTROIDS, quantizer.centroids),
        (CODEBOOKS, quantizer.codebooks.reshape(parts, codes * width)),
    ):
        rows = _matrix_rows(versions.spark, values)
        table = empty_table(rows.schema, ["place"], buckets=1)
        out[name] = versions.replaced(table, f"{folder}/{name}", rows)
    return out


def quantizer_of(versions: Versions, manifest: Manifest) -> Quantizer:
    centroids = _matrix_of(versions.read(CENTROIDS, manifest))
    books = _matrix_of(versions.read(CODEBOOKS, manifest))
    parts = len(books)
    return Quantizer(centroids, books.reshape(parts, -1, centroids.shape[1] // parts))


def build(
    rows: DataFrame,
    index: ListIndex,
    lists: int,
    parts: int,
    codes: int = 16,
    train_rows: int = TRAIN_ROWS,
) -> Manifest:
    """Train on about ``train_rows`` rows and index all; keys are distinct.

    ``parts`` divides the length of the longest vector; each costs a byte a row.
    """
    spark, versions = rows.sparkSession, index.versions(rows.sparkSession)
    base = versions.manifest()
    dimensions = rows.agg(F.max(F.size(index.vector))).collect()[0][0] or 0
    if dimensions < parts or dimensions % parts:
        raise ValueError(f"{parts} parts of {dimensions} dimensions")
    units = materialize(_units(rows, index, dimensions), "units")
    quantizer = train(units, list(index.keys), lists, parts, codes, train_rows)
    version, folder = base.version + 1, f"build/{base.version}"
    placed = _encoded(units, quantizer).withColumn("version", F.lit(version).cast("long"))
    table = empty_table(placed.schema, index.keys, buckets=lists)
    tables = _with_quantizer(versions, {}, folder, quantizer)
    tables[LISTS] = versions.placed(table, f"{folder}/{LISTS}", placed, "list")
    dead = StructType([*[rows.schema[k] for k in index.keys], StructField("version", LongType())])
    tables[DEAD] = empty_table(dead, index.keys, buckets=1)
    return versions.commit(replace(base, tables=tables))


def upsert(rows: DataFrame, index: ListIndex, gone: DataFrame | None = None) -> Manifest:
    """Add rows with distinct keys, in the place of those with equal keys, and remove the
    keys of ``gone``.  Writes the new rows and tombstones, and no file anew."""
    versions = index.versions(rows.sparkSession)
    base = versions.manifest()
    version, folder = base.version + 1, f"upsert/{base.version}"
    quantizer = quantizer_of(versions, base)
    placed = materialize(_list_rows(rows, index, quantizer, version), "placed")
    lists = versions.placed(base.tables[LISTS], f"{folder}/{LISTS}", placed, "list")
    named = placed.select(*index.keys)
    if gone is not None:
        named = named.unionByName(gone.select(*index.keys)).distinct()
    dead = named.withColumns({"version": F.lit(version).cast("long"), "bucket": F.lit(0)})
    tombstones = versions.placed(base.tables[DEAD], f"{folder}/{DEAD}", dead, "bucket")
    return versions.commit(
        replace(base, tables=base.tables | {LISTS: lists, DEAD: tombstones})
    )


def live(versions: Versions, manifest: Manifest, lists: Sequence[int] | None = None) -> DataFrame:
    """The rows that count, of all lists or some; reads the files of these."""
    table = manifest.tables[LISTS]
    wanted = table.files if lists is None else {b: table.files.get(b, ()) for b in lists}
    rows = versions.read_files(table, [p for paths in wanted.values() for p in paths])
    if not manifest.tables[DEAD].files:
        return rows
    keys = list(table.keys)
    dead = versions.read(DEAD, manifest).groupBy(*keys).agg(F.max("version").alias("until"))
    dead = small_side(dead, "dead", 500_000)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    later = F.col("d.until") > F.col("r.version")
    return rows.alias("r").join(dead.alias("d"), [*same, later], "left_anti")


def maintain(
    spark: SparkSession,
    index: ListIndex,
    max_rows: int,
    dead_share: float = DEAD_SHARE,
    max_files: int = FILES_PER_BUCKET,
) -> dict[str, int]:
    """Write lists anew that hold dead rows, if these are more than a share of all rows, or
    that have too many files, and split those of more than ``max_rows`` rows in two.

    Returns how many lists were ``rewritten`` and ``split``; nothing is committed if none.
    """
    versions = index.versions(spark)
    base = versions.manifest()
    table = base.tables[LISTS]
    everything = versions.read(LISTS, base).groupBy("list").agg(F.count("*").alias("stored"))
    sizes = live(versions, base).groupBy("list").agg(F.count("*").alias("live"))
    counts = {
        r["list"]: (r["stored"], r["live"] or 0)
        for r in everything.join(sizes, "list", "left").collect()
    }
    stored = sum(s for s, _ in counts.values())
    buried = stored - sum(n for _, n in counts.values())
    merging = bool(base.tables[DEAD].files) and buried >= dead_share * max(stored, 1)
    outgrown = sorted(b for b, (_, n) in counts.items() if n > max_rows)
    anew = {b for b, (s, n) in counts.items() if merging and s > n}
    anew |= {b for b, paths in table.files.items() if len(paths) > max_files}
    if not anew and not outgrown:
        return {"rewritten": 0, "split": 0}

    version, folder = base.version + 1, f"maintain/{base.version}"
    quantizer = quantizer_of(versions, base)
    tables = dict(base.tables)
    touched = sorted(anew | set(outgrown))
    rows = live(versions, base, touched)
    if outgrown:
        quantizer = _split(rows.where(F.col("list").isin(outgrown)), quantizer, outgrown)
        tables = _with_quantizer(versions, tables, folder, quantizer)
        # Rows move only from a split list, and only to one of its two halves.
        kept = rows.where(~F.col("list").isin(outgrown))
        moved = _halves(rows.where(F.col("list").isin(outgrown)), quantizer, outgrown)
        rows = kept.unionByName(moved)
    rows = rows.withColumn("version", F.lit(version).cast("long"))
    rows = materialize(rows, "rewritten")
    grown = replace(table, buckets=len(quantizer.centroids))
    tables[LISTS] = versions.placed(grown, f"{folder}/{LISTS}", rows, "list", touched)
    if merging:
        tables[DEAD] = replace(tables[DEAD], files={})
    versions.commit(replace(base, tables=tables))
    return {"rewritten": len(touched), "split": len(outgrown)}


def _split(rows: DataFrame, quantizer: Quantizer, outgrown: list[int]) -> Quantizer:
    """Two centroids in the place of one, for all outgrown lists at once; the second ones
    are new lists at the end."""
    numbers = F.array_position(F.array(*[F.lit(b) for b in outgrown]), F.col("list")) - 1
    points = materialize(
        rows.select(
            numbers.cast("int").alias("group"), F.col("unit").cast("array<double>").alias("vector")
        ),
        "points",
    )
    # The seeds are two rows far from each other: the one that comes first in the order of
    # its values, and the one that is least like it.
    first = points.groupBy("group").agg(F.min("vector").alias("a"))
    like = dot(F.col("vector"), F.col("a"))
    pairs = (
        points.join(F.broadcast(first), "group")
        .groupBy("group")
        .agg(F.first("a").alias("a"), F.min_by("vector", like).alias("b"))
        .collect()
    )
    seeds = np.zeros((len(outgrown), 2, quantizer.dimensions))
    for r in pairs:
        seeds[r["group"]] = [r["a"], r["b"]]
    halves = lloyd(points, seeds)
    centroids = quantizer.centroids.copy()
    centroids[outgrown] = halves[:, 0]
    return replace(quantizer, centroids=np.concatenate([centroids, halves[:, 1]]))


def _halves(rows: DataFrame, quantizer: Quantizer, outgrown: list[int]) -> DataFrame:
    old = len(quantizer.centroids) - len(outgrown)
    other = {b: old + i for i, b in enumerate(outgrown)}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = matrix(batch.column("unit"), quantizer.dimensions)
            first = batch.column("list").to_numpy().astype(np.int64)
            second = np.array([other[b] for b in first.tolist()], np.int64)
            c = quantizer.centroids
            apart = [((unit - c[x]) ** 2).sum(axis=1) for x in (first, second)]
            lists = np.where(apart[0] <= apart[1], first, second)
            codes = [row.tobytes() for row in quantizer.codes_of(unit, lists)]
            new = {"list": pa.array(lists, pa.int32()), "code": pa.array(codes, pa.binary())}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return rows.mapInArrow(run, rows.schema)


# -- search --------------------------------------------------------------------


def _probes(units: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, wanted: int) -> list:
    """Per query its nearest lists until these hold ``wanted`` rows."""
    near = units @ centroids.T - 0.5 * (centroids**2).sum(axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    filled = np.cumsum(sizes[order], axis=1)
    return [o[: int(np.searchsorted(f, wanted)) + 1] for o, f in zip(order, filled, strict=True)]


class _Best:
    """The best rows by code of every query, over the rows seen so far."""

    def __init__(self, units: np.ndarray, quantizer: Quantizer, survivors: int):
        self.units, self.quantizer, self.survivors = units, quantizer, survivors
        parts, _, width = quantizer.codebooks.shape
        cut = units.reshape(len(units), parts, width)
        # Products of the queries' parts with all codes (query, part, code).
        self.tables = np.einsum("qpw,pcw->qpc", cut, quantizer.codebooks)
        self.scores = [np.zeros(0)] * len(units)
        self.rows = [np.zeros(0, np.int64)] * len(units)

    def add(self, queries: np.ndarray, list_number: int, codes: np.ndarray, rows: np.ndarray):
        """Rows (numbers) of one list, with their codes, for the queries that probe it."""
        start = self.units[queries] @ self.quantizer.centroids[list_number]
        scores = np.repeat(start[:, None], len(rows), axis=1)
        for part in range(codes.shape[1]):
            scores += self.tables[queries, part][:, codes[:, part]]
        for q, found in zip(queries.tolist(), scores, strict=True):
            both = np.concatenate([self.scores[q], found])
            who = np.concatenate([self.rows[q], rows])
            if len(both) > self.survivors:
                top = np.argpartition(-both, self.survivors - 1)[: self.survivors]
                both, who = both[top], who[top]
            self.scores[q], self.rows[q] = both, who

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, score) of all that is left."""
        number = np.repeat(np.arange(len(self.rows)), [len(r) for r in self.rows])
        return number, np.concatenate(self.rows), np.concatenate(self.scores)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(len(column), parts)


def _candidates(table: pa.Table, asked, ids: pa.Array, quantizer, survivors: int) -> pa.Table:
    """The best rows by code of each query: (query id, keys, approximate score)."""
    units, probes = asked
    best = _Best(units, quantizer, survivors)
    lists = table.column("list").to_numpy()
    codes = _codes(table.column("code").combine_chunks(), len(quantizer.codebooks))
    order = np.argsort(lists, kind="stable")
    cuts = np.flatnonzero(np.diff(lists[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        number = int(lists[rows[0]])
        queries = np.flatnonzero([number in p for p in probes])
        step = max(1, min(SLICE_ROWS, SLICE_SCORES // max(len(queries), 1)))
        for start in range(0, len(rows) if len(queries) else 0, step):
            part = rows[start : start + step]
            best.add(queries, number, codes[part], part)
    query, row, score = best.found()
    out = table.drop_columns(["list", "code"]).take(pa.array(row))
    out = out.add_column(0, "query_id", ids.take(pa.array(query)))
    return out.append_column("approximate", pa.array(score))


def search(
    spark: SparkSession,
    index: ListIndex,
    queries: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    *,
    probed_share: float = PROBED_SHARE,
    survivors: int | None = None,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    max_shipped: int = MAX_SHIPPED_QUERIES,
    manifest: Manifest | None = None,
) -> DataFrame:
    """Approximate top k of every query: query id, keys, score (cosine, exact) and rank.

    Lists are probed until they hold ``probed_share`` of the rows, and at least as many as
    survive, so every query gets k rows if there are that many.
    """
    check_top_k(top_k)
    versions = index.versions(spark)
    manifest = manifest or versions.manifest()
    quantizer = quantizer_of(versions, manifest)
    keys = list(index.keys)
    counts = live(versions, manifest).groupBy("list").agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(len(quantizer.centroids), np.int64)
    for r in counts:
        sizes[r["list"]] = r["n"]
    total = int(sizes.sum())
    if survivors is None:
        most = max(2 * top_k, int(SURVIVING_SHARE * total))
        survivors = min(SURVIVORS_PER_RESULT * top_k, most)
    wanted = min(total, max(int(probed_share * total), survivors))

    unit = unit_vector(F.col(query_vector), quantizer.dimensions)
    asked = materialize(
        queries.select(F.col(query_id).alias("query_id"), unit.alias("query")), "asked"
    )
    schema = StructType(
        [
            asked.schema["query_id"],
            *[manifest.tables[LISTS].struct()[k] for k in keys],
            StructField("approximate", DoubleType()),
        ]
    )
    count = asked.count()
    # A task gives as many rows for each query as survive, whatever the number of lists it
    # reads; queries are sent in slices, so that neither these rows nor the scores of a task
    # grow with the number of queries.
    slices = max(1, -(-count // max(max_shipped, 1)))
    near = None
    for number in range(slices):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == number)
        found = _shipped(versions, manifest, some, quantizer, sizes, wanted, survivors, schema)
        found = materialize(
            numbered_results(found.withColumnRenamed("approximate", "score"), keys)
            .where(F.col("rank") <= survivors)
            .select("query_id", *keys),
            "survivors",
        )
        near = found if near is None else near.unionByName(found)
    named = near if count * survivors > 200_000 else F.broadcast(near)
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    scored = (
        live(versions, manifest)
        .alias("v")
        .join(named.alias("n"), same)
        .select("n.query_id", *[F.col(f"v.{k}") for k in keys], F.col("v.unit").alias("unit"))
        .join(asked if count > max_shipped else F.broadcast(asked), "query_id")
        .select("query_id", *keys, _cosine(F.col("query"), F.col("unit")).alias("score"))
    )
    hits = numbered_results(scored, keys).where(F.col("rank") <= top_k)
    return hits.withColumnRenamed("query_id", query_id)


def _cosine(query: Column, unit: Column) -> Column:
    """Product of unit vectors; stored in single precision, so the norm is taken again."""

    unit = unit.cast("array<double>")
    size = norm(unit)
    score = F.when(size > 0, dot(query, unit) / size).otherwise(0.0)
    return F.round(score, SCORE_DECIMALS) + F.lit(0.0)


def _shipped(versions, manifest, asked, quantizer, sizes, wanted, survivors, schema) -> DataFrame:
    """The best by code of some queries, all in every task; reads the lists that any probes."""
    table = asked.toArrow()
    ids = table.column(0).combine_chunks()
    units = matrix(table.column(1).combine_chunks(), quantizer.dimensions)
    probes = _probes(units, quantizer.centroids, sizes, wanted)
    lists = sorted({int(b) for p in probes for b in p})
    keys = list(manifest.tables[LISTS].keys)
    rows = live(versions, manifest, lists).select(*keys, "list", "code")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held and len(ids):
            found = _candidates(
                pa.Table.from_batches(held), (units, probes), ids, quantizer, survivors
            )
            yield from found.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)
