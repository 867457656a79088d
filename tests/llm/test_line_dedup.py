from __future__ import annotations

import random
import re

import pytest

from lexweave.llm.line_dedup import dedup_lines


def brute(rows, least):
    """Lines that lie in a run of enough words that occurred before, by trying all runs."""
    seen, gone = set(), {}
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = [(i, " ".join(re.split(r"[\x20\x09-\x0D]+", x)).strip()) for i, x in enumerate(text.split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        for start in range(len(lines)):
            words, run = 0, []
            for end in range(start, len(lines)):
                run.append(lines[end][1])
                words += len(lines[end][1].split())
                if words >= least:
                    if tuple(run) in seen:
                        gone.setdefault(doc, set()).update(i for i, _ in lines[start : end + 1])
                    seen.add(tuple(run))
    return {
        doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ()))
        for doc, text in rows
    }


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 1, 2, 3, 6]))) for _ in range(25)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(lines))
            parts += lines[at : at + rng.randrange(1, 6)]
            if rng.random() < 0.3:
                parts.append(rng.choice(["", "  ", "new %d words here" % rng.randrange(10**6)]))
        rows.append((doc, "\n".join(parts)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, lines[0] + "  \t"), (64, "\n".join([lines[3]] * 9))]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, gone int").repartition(3)
    got = {r.doc_id: r for r in dedup_lines(df, min_words=5).collect()}
    assert {d: r.text for d, r in got.items()} == brute(rows, 5)
    assert got[60].n_lines == 0 and got[61].n_lines == 1
    assert all(r.text is None or r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.n_lines > r.n_removed else 0) for r in got.values())


def test_long_passages_go_and_clean_lines_stay(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"own line {i} of this text\n{passage}\nThe end.") for i in range(30)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own line {i} of this text" for i in range(1, 30))


def test_short_lines_between_new_lines_go(spark):
    rows = [(i, f"Terms of use\nfirst new {i}\n\nAll rights are reserved here .\nsecond new {i}\n}}") for i in range(20)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"first new {i}\n\nsecond new {i}" and got[i].n_removed == 3 for i in range(1, 20))


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    line = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(1, line), (1, line), (None, line), (2, line + "\nnew")]
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, ""), (1, ""), (None, line), (2, "new")], key=repr)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_native(spark):
    from tests.conftest import plan_of

    plan = plan_of(dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string")))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_passages_go_by_windows_of_several_lines_and_the_rest_as_in_brute_force(spark, monkeypatch):
    from lexweave.llm import line_dedup

    looked_up, repeated = [], line_dedup._repeated

    def counted(lines, min_words):
        looked_up.append((min_words, lines.count()))
        return repeated(lines, min_words)

    monkeypatch.setattr(line_dedup, "_repeated", counted)
    rng = random.Random(7)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 6]))) for _ in range(40)]
    rows = [(doc, "\n".join(lines[at : at + rng.randrange(1, 12)] + [f"new {doc}"])) for doc, at in enumerate(rng.choices(range(30), k=60))]
    rows += [(60, "\n".join([lines[3]] * 9)), (61, "\n \n" + lines[0]), (62, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == brute(rows, 1)
    (passage, of_all), (single, left) = looked_up
    assert passage > 1 == single and left < of_all / 2
