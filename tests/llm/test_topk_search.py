from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<double>, rank string, score string"


def brute(rows, k):
    good = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % 5 == 0}):
        vector = min(v for i, v in good if i == q)
        scores = [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in good if i != q]  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("slices", [2048, 7])
def test_matches_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(ts, "SLICE_QUERIES", slices)
    monkeypatch.setattr(ts, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).round(3).tolist(), "a", "b") for i in rng.permutation(150)]
    # Many equal vectors, zeros, ragged and unusable ones, a repeated id.
    rows += [(1000 + i, [0.5] * 6, "a", "b") for i in range(80)]
    rows += [(2000, [0.0] * 6, "", ""), (2005, [1.0], "", ""), (2010, [], "", ""), (2015, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0], "", "")]
    rows += [(3000, None, "", ""), (3005, [None] * 6, "", ""), (3010, [math.nan] * 6, "", ""), (3015, [math.inf] * 6, "", ""), (None, [1.0] * 6, "", "")]
    rows += [(5, [9.0] * 6, "", ""), (5, [-9.0] * 6, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = ts.exact_topk(df, F.col("vec_id") % 5 == 0, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (5, [2.0], "", ""), (7, [1.0], "", "")], SCHEMA)
    got = ts.exact_topk(df, F.col("vec_id") % 5 == 0, k=10)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 5, 2 << 20), (0, 2, 7, 1 << 20), (5, 1, 0, 2 << 20), (5, 2, 7, 2 << 20)]
    assert ts.exact_topk(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_are_exact_or_refused(spark):
    rows = [(0, [1.0, 2.0], "", ""), (1, [4e9, 1.0], "", ""), (2, [-4e9, 3.0], "", ""), (3, [1e12, -5e11], "", ""), (4, [1e12, 0.5], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ts.exact_topk(df, F.col("vec_id") % 5 == 0, k=10).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    for far in (1e300, 4e15, -1e20):
        with pytest.raises(Exception, match="too large"):
            ts.exact_topk(df.union(spark.createDataFrame([(7, [far, 1.0], "", ""), (10, [far, 1.0], "", "")], SCHEMA)), F.col("vec_id") % 5 == 0).collect()


def test_one_broadcast_at_a_time(spark, monkeypatch):
    held, most = set(), []
    monkeypatch.setattr(ts, "SLICE_QUERIES", 5)
    context = type(spark.sparkContext)
    original = context.broadcast

    def counted(self, value):
        made = original(self, value)
        if isinstance(value, tuple) and len(value) == 2:
            held.add(id(made))
            most.append(len(held))
            destroy = made.destroy
            made.destroy = lambda blocking=False: (held.discard(id(made)), destroy(blocking))
        return made

    monkeypatch.setattr(context, "broadcast", counted)
    df = spark.createDataFrame([(i, [float(i), 1.0], "", "") for i in range(125)], SCHEMA)
    assert ts.exact_topk(df, F.col("vec_id") % 5 == 0, k=3).count() == 75
    assert len(most) == 5 and set(most) == {1} and not held
