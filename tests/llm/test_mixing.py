from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm.mixing import mixed_copies, mixed_rows

SCHEMA = "doc_id long, text string, source string, target string, copies int"


def targets(sizes):
    """Targets by sharing the excess out again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    wanted, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = wanted - sum(capped.values())
        got = {s: share * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if got[s] > 2 * sizes[s]}
        if not above:
            return got | capped
        capped |= above


def rows_of(n=3000):
    rng = random.Random(5)
    names = ["b", "a", "É", "z", None, "", "hot", "hot", "hot", "hot"]
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 3, 10, 50, 50, 200])
        rows.append((i, rng.choice([" ", "\n"]).join(["w"] * words) if words else rng.choice([None, "", " "]), rng.choice(names), "x", 1))
    return rows + [(n, "w " * 5000, "a", "x", 1), (n + 1, None, "nothing", "x", 1)]


def test_targets_and_words_taken(spark):
    rows = rows_of()
    got = mixed_copies(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"]
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate + 1e-9) <= r.copies <= int(rate + 1 - 1e-9) or not r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    # All but the last document of a source is rounded without a change of its words.
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(rows_of(800), SCHEMA)
    first, second = (sorted((r.doc_id, r.copies) for r in mixed_copies(df.repartition(n)).collect()) for n in (2, 7))
    assert first == second


def test_probabilities_are_kept(spark):
    """Over many documents of one size, each part of a source is taken at the source's rate."""
    rows = [(i, "w " * 10, "a" if i % 4 else "b", "x", 1) for i in range(8000)]
    got = mixed_copies(spark.createDataFrame(rows, SCHEMA)).groupBy("source", F.col("doc_id") < 4000).agg(
        F.avg("copies").alias("copies"), F.avg(F.col("target") / F.col("source_size")).alias("rate")
    )
    assert all(abs(r.copies - r.rate) < 0.04 for r in got.collect())


def test_rows_are_repeated(spark):
    rows = rows_of(300) + [(5, "same id other text", "hot", "x", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixed_rows(df)
    assert mixed.columns == df.columns
    want = {}
    for r in mixed_copies(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_repeated_and_missing_ids_and_empty_tables(spark):
    rows = [(1, "a b", "s", "x", 1)] * 5 + [(None, "a b c", "s", "x", 1)] * 4 + [(2, "a", None, "x", 1)]
    got = mixed_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert mixed_copies(empty).count() == 0 and mixed_rows(empty).count() == 0


def test_rows_of_the_mix_keep_columns_of_any_name(spark):
    names = ["__copies", "__copy", "copies", "copy", "row", "words", "own_id", "size", "target"]
    rows = [(i, "one two three", "ab"[i % 2], *range(9)) for i in range(20)] + [(None, None, None, *range(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixed_rows(df)
    assert got.columns == df.columns and got.count() > 20
    assert all(tuple(r)[3:] == tuple(range(9)) for r in got.collect())
