"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
import check_oracle
from lexweave.catalog.registry import ORACLES, QUERIES
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_oracle.connection(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    problem = check_oracle.compare(spark, con, sf_dir, name)
    # At the smallest scale a filter may leave nothing; the larger ones have rows.
    assert problem in ("", "equal but empty"), problem


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["clean_text", "fallback_chunks", "silver_chunks", "article_segments", "gold_chunks", "embed_chunks"]
)
def test_text_work_stays_in_the_jvm(spark, sf_dir, name):
    plan = plan_of(contract.queries()[name](spark, sf_dir))
    for operator in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert operator not in plan


def test_chunking_plain_documents_needs_no_shuffle(spark, sf_dir):
    from lexweave.catalog import inputs

    plan = plan_of(inputs.plain_chunks(spark, sf_dir))
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning")
    assert "posexplode" in plan and "size(transform" not in plan


def test_python_workers_need_no_copy_of_the_package(sf_dir, tmp_path):
    """Run from elsewhere, as a driver that only puts the repository on its path."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(contract.__file__).parent)!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
names = ["topk_batch", "ann_search", "embed_batches", "ingest_all", "evaluate_failures", "ask"]
print("rows", [contract.queries()[n](spark, {sf_dir!r}).count() > 0 for n in names])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script],
        cwd=tmp_path,
        env=env,
        capture_output=True,
        text=True,
        timeout=300,
        check=False,
    )
    assert f"rows {[True] * 6}" in done.stdout, done.stderr[-2000:]
