from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
import check_oracle
import corpus_pipeline
from lexweave.llm import queries
from lexweave.llm.mixing import mixed_copies
from lexweave.llm.tables import table
from lexweave.storage import materialize
from tests.llm import test_exact_dedup, test_jaccard_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(queries.QUERIES) <= names and set(queries.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert check_oracle.compare(spark, check_oracle.connection(sf_dir), sf_dir, name) == ""


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf_dir), "stage")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        left = [(r.doc_id, r.text) for r in after.collect()]
        assert set(left) <= set(rows)
        if name == "toxicity":
            toxic = {r.doc_id for r in contract.queries()["op8_toxicity"](spark, sf_dir).collect() if r.predicted}
            assert sorted(left) == sorted(r for r in rows if r[0] not in toxic)
        elif name == "exact dedup":
            keep = {k for _, k, _, _ in test_exact_dedup.brute([(*r, 0) for r in rows])}
            assert sorted(i for i, _ in left) == sorted(keep)
        elif name.startswith("n-gram"):
            want = test_jaccard_join.brute(rows, 5, 80)
            assert sorted(i for i, _ in left) == sorted(i for i, (_, c) in want.items() if i == c)
        elif name.startswith("mixing"):
            copies = {r.doc_id: r.copies for r in mixed_copies(before).collect() if r.copies}
            assert sorted(i for i, _ in left) == sorted(i for i, n in copies.items() for _ in range(n))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == COLUMNS
            assert dict(after.dtypes) == dict(docs.dtypes)
        before = after
    assert after.columns == [*COLUMNS, "n_pieces", "pieces", "round_trip"]
    assert all(r.round_trip for r in after.collect())
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.n_pieces) for r in df.select("doc_id", "n_pieces").collect())
    assert key(whole) == key(after)


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "word here", None, "b", 9), (3, "w " * 200_000, "en", "a", 5)]
    schema = table(spark, sf_dir, "documents").schema
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns[:5] == COLUMNS


def test_the_rest_works_without_this_folder(tmp_path):
    """A copy of the repository without the folders imports and keeps its queries."""
    root = Path(contract.__file__).parent
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("lexweave.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
print(len(e.queries()), "op1_exact_dedup" in e.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100, check=False)
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) >= 88
