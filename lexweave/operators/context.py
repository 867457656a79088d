"""Context, sources and prompts from ranked search results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.citations import INSUFFICIENT
from lexweave.functions.text import first_non_zero, non_empty, preview

SOURCE_PREVIEW_CHARS = 1200
MODEL_BATCH = 64
CONTEXT_SEPARATOR = "\n\n---\n\n"
SOURCE_SEPARATOR = "\n\n"
NO_RESULTS_ANSWER = "No relevant regulatory context was found for this question."

PROMPT = (
    "Answer the question from the excerpts below and from nothing else. Support every "
    "claim with a citation [Document: name, Article n, page n]. If the excerpts cover "
    "only a part, say what is missing; if they contradict each other, report both. If "
    f'they do not help, reply: "{INSUFFICIENT}."\n\n'
    "## Excerpts\n{context}\n\n## Question\n{question}\n\n## Answer\n"
)

# Takes questions and prompts, returns answers.
AnswerModel = Callable[[pd.Series, pd.Series], pd.Series]


def _shown(value: Column) -> Column:
    """Missing values show as the word None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def context_header() -> Column:
    """``[title (version) | location | Page p]`` of a result row."""
    title = F.coalesce(non_empty(F.col("regulation_title")), _shown(F.col("file_name")))
    version = non_empty(F.col("document_version"))
    page = F.concat(F.lit("Page "), _shown(F.col("page_number")))
    part = F.when(
        F.col("part_count") > 1,
        F.concat(
            F.lit(" — Part "), F.col("part_index") + 1, F.lit("/"), F.col("part_count")
        ),
    ).otherwise(F.lit(""))
    article, annex = non_empty(F.col("article_number")), non_empty(F.col("annex_number"))
    location = (
        F.when(article.isNotNull(), F.concat(F.lit("Article "), article, part))
        .when(annex.isNotNull(), F.concat(F.lit("Annex "), annex))
        .otherwise(page)
    )
    reference = F.concat(
        title, F.coalesce(F.concat(F.lit(" ("), version, F.lit(")")), F.lit(""))
    )
    return F.concat(
        F.lit("["), reference, F.lit(" | "), location, F.lit(" | "), page, F.lit("]")
    )


def context_block() -> Column:
    return F.concat(context_header(), F.lit("\n"), F.col("chunk_text"))


def shown_page() -> Column:
    """The page of a source: zero counts as missing unless nothing else is known."""
    return F.coalesce(first_non_zero(F.col("page_number")), F.col("page_number"))


def source_block() -> Column:
    fields = [
        ("File", F.col("file_name")),
        ("Page", shown_page()),
        ("Article", F.col("article_number")),
        ("Title", F.col("title")),
        ("Regulation", F.col("regulation_family")),
    ]
    lines = [F.concat(F.lit("[Source "), F.col("rank"), F.lit("]"))]
    lines += [F.concat(F.lit(f"{name}: "), _shown(value)) for name, value in fields]
    lines += [F.lit("Text:"), F.coalesce(F.col("chunk_text"), F.lit(""))]
    return F.concat(*[part for line in lines[:-1] for part in (line, F.lit("\n"))], lines[-1])


def joined_blocks(results: DataFrame, block: Column, separator: str) -> DataFrame:
    """One context per query; a query has at most top-k rows to join."""
    return results.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))),
                lambda b: b["block"],
            ),
            separator,
        ).alias("context")
    )


def build_context(results: DataFrame) -> DataFrame:
    return joined_blocks(results, context_block(), CONTEXT_SEPARATOR)


def source_context(results: DataFrame) -> DataFrame:
    return joined_blocks(results, source_block(), SOURCE_SEPARATOR)


def prompt(context: Column, question: Column) -> Column:
    before, rest = PROMPT.split("{context}")
    between, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(between), question, F.lit(after))


def rag_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """A prompt per question; one without results gets the fixed answer instead."""
    return questions.join(contexts, "query_id", "left").select(
        "query_id",
        "question",
        F.coalesce("context", F.lit("")).alias("context"),
        F.when(
            F.col("context").isNotNull(), prompt(F.col("context"), F.col("question"))
        ).alias("prompt"),
        F.when(F.col("context").isNull(), F.lit(NO_RESULTS_ANSWER)).alias("answer"),
    )


def sources(results: DataFrame) -> DataFrame:
    """Source rows as shown next to an answer."""
    return results.select(
        "query_id",
        F.col("rank").alias("source_index"),
        "chunk_uid",
        F.col("file_name").alias("source_file"),
        shown_page().alias("page"),
        "article_number",
        "score",
        "distance",
        "title",
        "regulation_family",
        "source_path",
        preview(F.coalesce("chunk_text", F.lit("")), SOURCE_PREVIEW_CHARS).alias("text"),
    )


def _asked(model: AnswerModel, questions: pd.Series, prompts: pd.Series) -> list[tuple]:
    """(answer, error) of each row; a batch that fails is halved until the rows that the
    model fails on stand alone."""
    out: list[tuple] = [(None, None)] * len(questions)
    todo = [(0, len(questions))]
    while todo:
        start, end = todo.pop()
        try:
            answers = model(questions.iloc[start:end], prompts.iloc[start:end])
            out[start:end] = [(answer, None) for answer in answers]
        except Exception as failure:  # noqa: BLE001 - a failing row must not end the job
            if end - start == 1:
                out[start] = (None, f"{type(failure).__name__}: {failure}")
            else:
                middle = (start + end) // 2
                todo += [(middle, end), (start, middle)]
    return out


def generate_answers(
    prompts: DataFrame, model: AnswerModel, batch_size: int = MODEL_BATCH
) -> DataFrame:
    """Fill in answers with a model, ``batch_size`` rows at a time.  A question the model
    fails on keeps a null answer and an error."""
    schema = "query_id {}, question string, context string, answer string, error string"
    id_type = prompts.schema["query_id"].dataType.simpleString()
    ask = _asked

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            todo = frame["answer"].isna()
            answers = frame["answer"].astype(object).where(~todo, None)
            errors = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            asked = frame[todo]
            for start in range(0, len(asked), batch_size):
                part = asked.iloc[start : start + batch_size]
                found = ask(model, part["question"], part["prompt"])
                answers[part.index] = pd.Series([a for a, _ in found], index=part.index, dtype=object)
                errors[part.index] = pd.Series([e for _, e in found], index=part.index, dtype=object)
            yield pd.DataFrame(
                {
                    "query_id": frame["query_id"],
                    "question": frame["question"],
                    "context": frame["context"],
                    "answer": answers,
                    "error": errors,
                }
            )

    return prompts.mapInPandas(run, schema.format(id_type))
