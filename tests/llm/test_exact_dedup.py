from __future__ import annotations

import hashlib
import random
import re

import pytest

from lexweave.llm.exact_dedup import drop_copies, exact_groups

SCHEMA = "doc_id long, text string, kept string, row int"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["", None, " ", "a b", "a\t\n b", "a b", "x" * 40 + "1", "x" * 40 + "2", "é" * 5000]
    texts += [f"t{i} {'word ' * (i % 7)}" for i in range(30)]
    rows = [(i, rng.choice(texts), "no", i) for i in range(300)]
    # One group holds more rows than a partition; ids repeat, some are missing.
    rows += [(1000 + i, "hot  group", "no", i) for i in range(400)]
    rows += [(7, "a b", "no", 1), (7, "a b", "no", 2), (None, "hot group", "no", 3), (None, "only", "no", 4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = rows_of(seed)
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(t) for _, t, *_ in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_a_hot_group_spans_partitions(spark):
    rows = [(i, "same", "no", i) for i in range(5000)] + [(9000 + i, f"t{i}", "no", i) for i in range(50)]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(6))
    hot = [r for r in got.collect() if r.group_size > 1]
    assert len(hot) == 5000 and {(r.keep_id, r.group_size) for r in hot} == {(0, 5000)}
    assert [r.doc_id for r in hot if r.kept] == [0]


def test_rows_that_stay_keep_their_columns(spark):
    rows = rows_of(3)
    left = drop_copies(spark.createDataFrame(rows, SCHEMA))
    assert left.schema.simpleString() == "struct<doc_id:bigint,text:string,kept:string,row:int>"
    got = left.collect()
    assert all(tuple(r) in set(rows) for r in got)
    assert len(got) == len({norm(t) for _, t, *_ in rows})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0
