from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import jaccard_join as jj
from lexweave.llm.shingles import WordHasher, shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size=3, percent=90):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(seed, n=12, members=9):
    """Texts with members that differ in none to several words, so that some link and some do not."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 14, 25, 60, 150, 400]))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(base) // 30])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            rows.append((number, rng.choice([" ", "\n", " \t"]).join(words)))
            number += 1
    rows += [(number, None), (number + 1, ""), (number + 2, "One"), (number + 3, "one"), (number + 4, "É x"), (number + 5, "é x")]
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = jj.jaccard_components(df.repartition(3)).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = families(seed)
    assert found(spark, rows) == brute(rows)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 3)
    monkeypatch.setattr(jj, "CHUNK_SHINGLES", 400)
    rows = families(5, n=3, members=40)
    assert found(spark, rows) == brute(rows)


def test_trees_find_links_without_the_smallest_set(spark, monkeypatch):
    """With every group small no pair comes from the comparison with the smallest set."""
    monkeypatch.setattr(jj, "SMALL_GROUP", 10**9)
    rows = families(7)
    assert found(spark, rows) == brute(rows)


def test_large_groups_meet_their_smallest_set_first(spark, monkeypatch):
    monkeypatch.setattr(jj, "SMALL_GROUP", 1)
    monkeypatch.setattr(jj, "BLOCK_SETS", 4)
    rows = families(8, n=5, members=30)
    rows += [(10_000 + i, t) for i, t in rows[:40]] + rows[:40]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.jaccard_components(got, size=5, numerator=80).collect()
    want = brute(rows, 5, 80)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got) and len(got) == len(rows)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (5, text + " end"), (None, text), (None, None), (9, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(3, 48, 3), (3, 48, 3), (5, 49, 3), (None, 48, None), (None, 0, None), (9, 1, 9)], key=repr)
    left = sorted(r.doc_id or -1 for r in jj.drop_near_copies(df).collect())
    assert left == [-1, -1, 3, 3, 9]
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    bands = jj.Bands(90, 100)
    for _ in range(300):
        n = int(rng.integers(10, 700))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(x) // 10 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both) and (len(x) != both or len(y) != both):
            assert np.intersect1d(jj.part_keys(x, bands), jj.part_keys(y, bands)).size


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 25)) :], rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for _ in range(90)]
    rows = [(i, len(s), i // 40, jj.bitmap(s)) for i, s in enumerate(sets)]
    pairs = {(int(a), int(b)) for x, y in jj._pairs_of_group(rows[:50], rows[20:], 90, 100) for a, b in zip(x, y, strict=True)}
    for i in range(50):
        for j in range(20, 90):
            both = len(np.intersect1d(sets[i], sets[j]))
            linked = 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)
            if linked and i // 40 != j // 40:
                assert (i, j) in pairs
    assert all(i // 40 != j // 40 for i, j in pairs)


def test_shingles_of_sliced_arrays_and_long_texts():
    texts = pa.array(["skip", None, "a B  c", "a b c d", "", "x " * 1_500_000, "A b C"])
    sets = list(shingle_sets(texts.slice(1), 3, WordHasher()))
    assert [len(s) for s in sets] == [0, 1, 2, 0, 1, 1]
    assert sets[1] == sets[5] and sets[1][0] in sets[2]


def test_near_copies_go_and_no_name_clashes(spark):
    rows = families(11, n=4)
    names = ["__gone", "gone", "own", "row", "n_shingles", "component_id", "key"]
    df = spark.createDataFrame([(*r, *range(7)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = jj.drop_near_copies(df, size=5, numerator=80, denominator=100)
    assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
    want = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert all(tuple(r)[2:] == tuple(range(7)) for r in got.collect())


def test_clusters_over_the_bound_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(jj, "CLUSTER_SHINGLES", 300)
    monkeypatch.setattr(jj, "BLOCK_SETS", 6)
    rows = families(9, n=4, members=20)
    assert found(spark, rows) == brute(rows)


def test_a_group_of_near_copies_gives_fewer_pairs_than_sets():
    """Of 300 sets that all may link, as of a chain in which neighbours do."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 200, 4)), rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for _ in range(300)]
    names = ["key", "gi", "uj", "side", "node", "n", "label", "bits"]
    rows = [(7, 0, 0, jj.BOTH, i, len(s), i, jj.bitmap(s)) for i, s in enumerate(sets)]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    pairs = {(a, b) for out in jj._traverse(iter([batch]), 90, 100, False) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert len(pairs) == 299
    reached = {0}
    while more := {y for pair in pairs for y in pair if reached & set(pair)} - reached:
        reached |= more
    assert len(reached) == 300


def test_whole_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    from lexweave.llm import tables
    from lexweave.llm.jaccard_join import jaccard_components

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    docs = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' word', 600)) AS text")
    spark.conf.unset(tables.BATCH_SETTING)
    try:
        jaccard_components(docs.limit(3)).collect()
        counts = [r.n for r in docs.mapInArrow(rows, "n long").collect()]
        assert sum(counts) == 8000 and max(counts) * 3000 < 2 * tables.BATCH_BYTES
        spark.conf.set(tables.BATCH_SETTING, "1m")
        tables.bounded_batches(spark)
        assert spark.conf.get(tables.BATCH_SETTING).startswith("1")
    finally:
        spark.conf.unset(tables.BATCH_SETTING)


def pairs_in_group(home, others, every=False):
    names = ["key", "gi", "uj", "side", "node", "n", "label", "bits"]
    rows = [(i, s, jj.BOTH if i in others and i in home else jj.HOME if i in home else jj.OUT) for i, s in {**home, **others}.items()]
    rows = [(7, 0, 0, side, i, len(s), i, jj.bitmap(s)) for i, s, side in rows]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    return [(a, b) for out in jj._traverse(iter([batch]), 80, 100, every) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]


def test_a_smaller_set_does_not_blur_the_bitmaps_of_its_group():
    """Sets that share next to nothing give no pair, though a set of half their width is there."""
    rng = np.random.default_rng(8)
    sets = {i: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for i, n in enumerate([254] + [397] * 80)}
    assert pairs_in_group(sets, sets) == []


@pytest.mark.parametrize("n", [70, 140, 540, 2200])
def test_sets_of_two_widths_lose_no_pair(n):
    """Of a tree with itself and of two, every linked pair is found and is connected."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sets = {i: np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, n // 4)) :], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for i in range(60)}
    assert len({len(jj.bitmap(s)) for s in sets.values()}) == 2
    for home, others in ((sets, sets), ({i: sets[i] for i in range(40)}, {i: sets[i] for i in range(25, 60)})):
        every, few = set(pairs_in_group(home, others, True)), pairs_in_group(home, others)
        labels = jj.Labels()
        for a, b in few:
            labels.join(a, b)
        linked = 0
        for a in home:
            for b in others:
                both = len(np.intersect1d(sets[a], sets[b]))
                if a != b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    linked += 1
                    assert (min(a, b), max(a, b)) in every and labels.of(a) == labels.of(b)
        assert linked and set(few) <= every and len(few) < len(sets)


def test_labels_are_joined_to_sets_and_not_to_the_rows_of_all_groups(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(jj, "SMALL_GROUP", 1)
    monkeypatch.setattr(jj, "BLOCK_SETS", 4)

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, label)

    materialize = jj.materialize
    monkeypatch.setattr(jj, "materialize", noted)
    rows = families(8, n=3, members=12)
    assert found(spark, rows) == brute(rows)
    assert "Join LeftOuter, (key" in plans["open-groups"] and "Join LeftOuter, (node" not in plans["open-groups"]


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_do_not_meet_by_their_empty_parts(percent):
    """Of sets with nothing in common few pairs share a key, however many have empty parts."""
    rng = np.random.default_rng(12)
    bands = jj.Bands(percent, 100)
    for n in (12, 60, 183, 270, 900):
        keys, rows = {}, 0
        for at in range(300):
            found = jj.part_keys(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)), bands)
            rows += len(found)
            for key in found.tolist():
                keys.setdefault(key, []).append(at)
        met = [len(x) for x in keys.values() if len(x) > 1]
        assert sum(met) < rows / 200 and max(met, default=0) < 20


def test_linked_sets_share_a_key_with_many_empty_parts():
    rng = np.random.default_rng(13)
    for percent in (50, 80, 90):
        bands, linked = jj.Bands(percent, 100), 0
        for _ in range(1500):
            n = int(rng.integers(2, 300))
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
            y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, len(x) * (100 - percent) // 100 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both < max(len(x), len(y)) and 100 * both >= percent * (len(x) + len(y) - both):
                linked += 1
                assert np.intersect1d(jj.part_keys(x, bands), jj.part_keys(y, bands)).size
        assert linked > 300


def test_labels_are_joined_once_to_the_rows_of_groups_of_several_blocks(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(jj, "SMALL_GROUP", 1)
    monkeypatch.setattr(jj, "BLOCK_SETS", 4)

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter, (rep")))
        return materialize(df, label)

    materialize = jj.materialize
    monkeypatch.setattr(jj, "materialize", noted)
    rows = families(8, n=3, members=12)
    assert found(spark, rows) == brute(rows)
    assert sum(n for label, n in plans) == sum(label == "open-blocks" for label, _ in plans) > 0
