from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexweave.operators.embed import embed_chunks
from lexweave.plans import evaluation as ev
from lexweave.plans import rag

PAGES = "document_id string, file_name string, page_number int, page_text string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"d{i}", f"d{i}.pdf", 1, f"Text number {i} about topic {i % 3}. " * 3) for i in range(12)]
    chunks = rag.ingest(spark.createDataFrame(rows, PAGES))
    for name in ("source_path", "source_name", "regulation_family"):
        chunks = chunks.withColumn(name, F.lit(None).cast("string"))
    return ev.materialize(embed_chunks(chunks).drop("embedding_model", "embedding_version"), "index")


def golden(spark, n=9):
    rows = [(i, "act", f"What about topic {i % 3}, number {i}?", "truth") for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, act string, question string, ground_truth string")


def test_a_stopped_run_repeats_no_call(spark, index, tmp_path, monkeypatch):
    asked, judged = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(questions, prompts):
        asked.add(len(questions))
        return questions + " Yes."

    def judge(kind, rows):
        judged.add(len(rows))
        if kind == "regenerated":
            return [[a] for a in rows["answer"]]
        return [["1"] for _ in range(len(rows))]

    folder, csv = str(tmp_path / "run"), str(tmp_path / "csv")
    original, batches = ev.judge_calls, []

    def stopped(calls, judge):
        batches.append(1)
        if len(batches) == 3:
            raise KeyboardInterrupt
        return original(calls, judge)

    options = {"top_k": 3, "batch_calls": 10}
    with monkeypatch.context() as patch:
        patch.setattr(ev, "judge_calls", stopped)
        with pytest.raises(KeyboardInterrupt):
            ev.evaluate_to_csv(csv, golden(spark), index, model, judge, folder, **options)
    assert asked.value == 9 and 0 < judged.value < 45
    failures = ev.evaluate_to_csv(csv, golden(spark), index, model, judge, folder, **options)
    # 9 answers, and for each of them two calls and one for each of three chunks.
    assert asked.value == 9 and judged.value == 45 and failures.isEmpty()
    rows = spark.read.option("header", True).csv(csv).collect()
    assert len(rows) == 9 and {(r.faithfulness, r.context_precision) for r in rows} == {("1.0", "1.0")}
    assert all(0.5 < float(r.response_relevancy) <= 1 for r in rows)
    again, _ = ev.evaluate(golden(spark), index, model, judge, folder, **options)
    assert again.count() == 9 and (asked.value, judged.value) == (9, 45)


def test_failing_calls_leave_out_their_question_and_can_be_tried_again(spark, index, tmp_path):
    def model(questions, prompts):
        if questions.str.contains("number 1?", regex=False).any():
            raise ValueError("no answer")
        return questions

    def judge(kind, rows):
        if rows["question"].str.contains("number 2?", regex=False).any():
            raise ValueError("no verdict")
        return [["1"] for _ in range(len(rows))]

    def better(kind, rows):
        return [["1"] for _ in range(len(rows))]

    folder = str(tmp_path / "run")
    scores, failures = ev.evaluate(golden(spark, 5), index, model, judge, folder, 2)
    assert {r.query_id: r.error for r in failures.collect()} == {"1": "ValueError: no answer", "2": "ValueError: no verdict"}
    assert sorted(r.query_id for r in scores.collect()) == ["0", "3", "4"]
    scores, failures = ev.evaluate(golden(spark, 5), index, model, better, folder, 2, retry_failed=True)
    assert [r.query_id for r in failures.collect()] == ["1"] and scores.count() == 4


def test_no_questions(spark, index, tmp_path):
    failures = ev.evaluate_to_csv(str(tmp_path / "csv"), golden(spark, 5).limit(0), index, None, None, str(tmp_path / "run"))
    assert failures.isEmpty() and not (tmp_path / "csv").exists()
