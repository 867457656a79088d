"""An evaluation run from questions to a table of scores, taken up again where it stopped.

Every call to a model, for an answer or a verdict, has a key: the question, the kind of
call and, for verdicts on retrieved chunks, the chunk's rank.  Calls are made in batches
by a hash of the key; what a batch gives is written before the next one begins.  A run
that was stopped finds its answers and verdicts in its folder and makes the other calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions.vectors import hash_embedding
from lexweave.operators import context
from lexweave.operators.embed import Encoder
from lexweave.operators.evaluate import evaluate_scores
from lexweave.plans.rag import retrieve
from lexweave.sinks.files import write_eval_csv
from lexweave.storage import exists, materialize

# Calls of one batch: what a run that is stopped may have to repeat at most.
BATCH_CALLS = 4096
# Rows that a judge sees at once.
JUDGE_ROWS = 64

ANSWER, STATEMENTS, REGENERATED, USEFUL = "answer", "statements", "regenerated", "useful"
_CALL = "query_id string, kind string, rank int"
_RESULT = f"{_CALL}, result array<string>, error string"

# Takes a kind and rows of (question, answer, passage); returns for each a list of texts:
# ``statements``: a verdict, 1 or 0, on each statement of the answer, by all passages;
# ``regenerated``: questions that the answer would answer; ``useful``: one verdict on the
# passage, a single chunk.
Judge = Callable[[str, pd.DataFrame], list[list[str]]]


def _judged(judge: Judge, kind: str, rows: pd.DataFrame) -> list[tuple]:
    """(result, error) of each row; rows that fail together are tried one by one."""
    try:
        return [([str(x) for x in found], None) for found in judge(kind, rows)]
    except Exception as failure:  # noqa: BLE001 - a failing call must not end the run
        if len(rows) == 1:
            return [(None, f"{type(failure).__name__}: {failure}")]
        return [x for i in range(len(rows)) for x in _judged(judge, kind, rows.iloc[i : i + 1])]


def judge_calls(calls: DataFrame, judge: Judge) -> DataFrame:
    """The result of each call (query_id, kind, rank, question, answer, passage)."""
    judged = _judged

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, rows in frame.groupby("kind", sort=False):
                for start in range(0, len(rows), JUDGE_ROWS):
                    part = rows.iloc[start : start + JUDGE_ROWS]
                    found = judged(judge, kind, part[["question", "answer", "passage"]])
                    yield part[["query_id", "kind", "rank"]].assign(
                        result=[r for r, _ in found], error=[e for _, e in found]
                    )

    return calls.mapInPandas(run, _RESULT)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Results written so far, one for each call: one without an error, if there is any."""
    if not exists(spark, path):
        return spark.createDataFrame([], _RESULT)
    rows = spark.read.schema(_RESULT).parquet(f"{path}/*")
    best = F.min_by(F.struct("result", "error"), F.col("error").isNotNull())
    return rows.groupBy("query_id", "kind", "rank").agg(best.alias("r")).select(
        "query_id", "kind", "rank", "r.*"
    )


def in_batches(
    calls: DataFrame,
    path: str,
    make: Callable[[DataFrame], DataFrame],
    batch_calls: int = BATCH_CALLS,
    retry_failed: bool = False,
) -> DataFrame:
    """Results of all calls; those that ``path`` holds already are not made again.

    A batch's results are in a folder of its own, so one that is written twice counts once.
    """
    spark, key = calls.sparkSession, ["query_id", "kind", "rank"]
    done = stored(spark, path)
    if retry_failed:
        done = done.where(F.col("error").isNull())
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    left = materialize(calls.alias("c").join(done.alias("d"), same, "left_anti"), "calls")
    batches = -(-left.count() // batch_calls)
    number = F.pmod(F.xxhash64(*key), F.lit(max(batches, 1)))
    run = materialize(left.select(number.alias("batch"), "*"), "numbered-calls")
    start = _folders(spark, path)
    for batch in range(batches):
        rows = run.where(F.col("batch") == batch).drop("batch")
        make(rows).write.mode("overwrite").parquet(f"{path}/{start + batch:06d}")
    return stored(spark, path)


def _folders(spark: SparkSession, path: str) -> int:
    """How many batches are written; the next one's number."""
    if not exists(spark, path):
        return 0
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(system.listStatus(place))


def _answers(prompts: DataFrame, folder: str, model, batch_calls: int, retry: bool) -> DataFrame:
    def make(calls: DataFrame) -> DataFrame:
        made = context.generate_answers(calls.drop("kind", "rank"), model)
        found = F.when(F.col("error").isNull(), F.array("answer"))
        return made.select(
            "query_id",
            F.lit(ANSWER).alias("kind"),
            F.lit(0).alias("rank"),
            found.alias("result"),
            "error",
        )

    calls = prompts.withColumns({"kind": F.lit(ANSWER), "rank": F.lit(0)})
    return in_batches(calls, folder, make, batch_calls, retry).select(
        "query_id", F.get("result", F.lit(0)).alias("answer"), "error"
    )


def _calls(answered: DataFrame, hits: DataFrame) -> DataFrame:
    """The judge's calls: two for each answer, and one for each of its chunks."""

    def call(kind: str, rows: DataFrame, rank: Column, passage: Column) -> DataFrame:
        return rows.select(
            "query_id",
            F.lit(kind).alias("kind"),
            rank.alias("rank"),
            "question",
            "answer",
            passage.alias("passage"),
        )

    chunks = answered.join(hits.select("query_id", "rank", "chunk_text"), "query_id")
    return (
        call(STATEMENTS, answered, F.lit(0), F.col("context"))
        .unionByName(call(REGENERATED, answered, F.lit(0), F.lit("")))
        .unionByName(call(USEFUL, chunks, F.col("rank"), F.col("chunk_text")))
    )


def _scores(verdicts: DataFrame, questions: DataFrame, encoder: Encoder) -> DataFrame:
    def items(kind: str, name: str) -> DataFrame:
        rows = verdicts.where((F.col("kind") == kind) & F.col("error").isNull())
        return rows.select("query_id", "rank", F.explode("result").alias(name))

    asked = questions.select("query_id", encoder(F.col("question")).alias("query_vector"))
    again = items(REGENERATED, "text").withColumn("regenerated_vector", encoder(F.col("text")))
    return evaluate_scores(
        items(STATEMENTS, "v").select("query_id", F.col("v").cast("int").alias("verdict")),
        again.join(asked, "query_id"),
        items(USEFUL, "v").select("query_id", "rank", F.col("v").cast("int").alias("verdict")),
    )


def evaluate(
    golden: DataFrame,
    embedded: DataFrame,
    model: context.AnswerModel,
    judge: Judge,
    folder: str,
    top_k: int = 5,
    encoder: Encoder = hash_embedding,
    batch_calls: int = BATCH_CALLS,
    retry_failed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Scores of all questions that worked (query_id and the columns of the CSV), and the
    failures (query_id, error).

    ``golden`` has query_id, act, question and ground_truth.  A question fails if its answer
    or one of its verdicts does, and is left out of the scores.  ``folder`` is the run's: the
    same golden rows, index and models belong to it.
    """
    golden = materialize(golden.withColumn("query_id", F.col("query_id").cast("string")), "golden")
    questions = golden.select("query_id", "question")
    hits = materialize(retrieve(questions, embedded, top_k, encoder), "hits")
    prompts = context.rag_prompts(questions, context.build_context(hits))
    prompts = materialize(prompts, "prompts")
    made = _answers(prompts, f"{folder}/answers", model, batch_calls, retry_failed)
    made = materialize(made, "answers")
    answered = prompts.drop("answer").join(made.where(F.col("error").isNull()), "query_id")
    calls = _calls(answered, hits)
    verdicts = materialize(
        in_batches(
            calls, f"{folder}/verdicts", lambda c: judge_calls(c, judge), batch_calls, retry_failed
        ),
        "verdicts",
    )
    failures = made.select("query_id", "error").unionByName(verdicts.select("query_id", "error"))
    failures = failures.where(F.col("error").isNotNull()).groupBy("query_id").agg(
        F.min("error").alias("error")
    )
    scores = _scores(verdicts, questions, encoder)
    worked = (
        golden.join(made.select("query_id", "answer"), "query_id")
        .join(failures, "query_id", "left_anti")
        .join(scores, "query_id", "left")
    )
    return worked.select("query_id", *schemas.EVAL_COLUMNS), failures


def evaluate_to_csv(path: str, *args, **options) -> DataFrame:
    """As ``evaluate``, with the scores as CSV files under ``path``; the failures."""
    scores, failures = evaluate(*args, **options)
    write_eval_csv(materialize(scores, "scores"), path)
    return failures
