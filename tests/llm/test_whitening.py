from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import feast
from lexweave.llm import whitening as wh
from lexweave.llm.tables import table


def residuals(matrix, count):
    values, vectors = feast.largest(matrix, count)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(values)]
    scale = np.abs(matrix).max()
    return (
        len(values),
        np.abs(values - want).max(initial=0.0) / scale,
        np.abs(matrix @ vectors - vectors * values).max(initial=0.0) / scale,
        np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0.0),
    )


TURN = np.linalg.qr(np.random.default_rng(0).normal(size=(40, 40)))[0]


@pytest.mark.parametrize(
    ("matrix", "count", "found"),
    [
        (np.cov(np.random.default_rng(1).normal(size=(300, 40)).T), 8, 8),
        (np.cov(np.random.default_rng(1).normal(size=(300, 40)).T), 40, 40),
        (np.array([[7.0]]), 8, 1),
        (np.eye(40) * 3, 8, 8),
        (np.diag([5.0, 0, 0, 0]), 8, 1),
        (TURN @ np.diag([5.0] * 3 + [2.0] * 20 + [1.0] * 17) @ TURN.T, 8, 8),
        (TURN @ np.diag(10.0 ** -np.arange(40)) @ TURN.T, 8, 8),
        (np.diag([1e6] + [1 + 1e-9 * i for i in range(39)]), 8, 8),
        (np.cov(np.random.default_rng(2).normal(size=(4, 40)).T), 8, 3),
    ],
)
def test_eigenvalues(matrix, count, found):
    number, *errors = residuals(matrix, count)
    assert number == found and max(errors) < 1e-12


def test_inertia_counts():
    matrix = TURN @ np.diag(np.arange(40.0)) @ TURN.T
    inertia = feast.Inertia(matrix)
    assert [inertia.above(x) for x in (-1, 0.5, 19.5, 38.5, 39.5)] == [40, 39, 20, 1, 0]
    assert abs(inertia.value(3) - 37) < 1e-12
    assert len(feast.largest(np.zeros((3, 3)), 8)[0]) == 0


def brute(rows, k=8):
    """Rows by numpy's eigenvectors; integers exactly."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]  # noqa: B905
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(x) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return good, n, deviation, centred @ vectors / np.sqrt(values), values / np.var(np.array(x), axis=0).sum()


def compared(got, rows, k=8):
    good, n, deviation, whitened, explained = brute(rows, k)
    found = {}
    for r in got.collect():
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert sum(len(x) for c in found.values() for x in c.values()) == n * len(explained)
    for c in range(len(explained)):
        mine = np.array([found[i, d][c + 1][0].whitened for (i, _), d in zip(good, deviation, strict=True)])
        theirs = whitened[:, c]
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-8
        one = found[good[0][0], deviation[0]][c + 1][0]
        assert one.n == n and abs(one.explained / explained[c] - 1) < 1e-9 and one.identity_error < 1e-9


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=12) * np.arange(1, 13)).tolist(), "a") for i in range(400)]
    rows += [(5, rows[5][1], "again"), (None, rows[6][1], "no id"), (900, [1.0, 2.0], "short"), (901, [], "empty")]
    rows += [(902, None, ""), (903, [None] * 12, ""), (904, [math.nan] * 12, ""), (905, [math.inf] * 12, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    got = wh.whitened_components(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compared(got, rows)


def test_blocks_and_wide_entries_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    # Products beyond 2^53 and sums of them beyond 2^62.
    rows = [(int(i), (rng.normal(size=4) * [4e5, 1e5, 3.0, 1.0]).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = wh.usable(df, "embedding").select("embedding")
    exact = np.array([[math.floor(1024 * c) for c in v] for _, v in rows], object)
    centre = np.array([1, 2, 3, 4], np.int64)
    z = exact - centre
    assert (wh._products(vectors, 1024, centre) == z.T @ z).all()
    assert wh._sums(vectors, 1024, 4) == (300, [int(s) for s in exact.sum(axis=0)])
    # A deviation beyond long integers.
    model = wh.fit(df, 2)
    got = {r.vec_id: int(r.deviation) for r in wh.whiten(df, model).collect()}
    assert got == dict(zip([i for i, _ in rows], map(int, ((300 * exact - exact.sum(axis=0)) ** 2).sum(axis=1)), strict=True))
    for far in (1e9, 1e300):
        with pytest.raises(Exception, match="entries too"):
            wh.fit(df.union(spark.createDataFrame([(1, [far] * 4)], df.schema)), 2)


def test_empty_and_equal_vectors(spark, sf_dir):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([(1, None)], schema)
    assert wh.whitened_components(none).count() == 0
    assert wh.whitened_components(none.limit(0)).count() == 0
    assert wh.whitened_components(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)
    assert sorted(abs(r.whitened) for r in wh.whitened_components(few).collect()) == [1.0, 1.0]
    df = table(spark, sf_dir, "embeddings")
    compared(wh.whitened_components(df), [tuple(r) for r in df.select("vec_id", F.col("embedding").cast("array<double>")).collect()])
