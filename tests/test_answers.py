from __future__ import annotations

import pandas as pd
import pytest

from lexweave.functions.citations import INSUFFICIENT
from lexweave.operators import answers, context, evaluate, report
from lexweave.plans import rag
from lexweave.operators.embed import embed_chunks

RESULT = (
    "query_id bigint, rank int, chunk_uid string, file_name string, page_number int, "
    "article_number string, annex_number string, title string, part_index int, part_count int, "
    "chunk_text string, regulation_title string, document_version string, "
    "regulation_family string, score double, distance double, source_path string"
)


def results(spark):
    rows = [
        (1, 2, "u2", "f.pdf", None, None, "IV", None, 0, 1, "second", None, None, None, 0.5, 0.5, None),
        (1, 1, "u1", "f.pdf", 7, "12a", None, "Aims", 1, 3, "first", "Data Act", "2016/1", "GDPR", 0.9, 0.1, "/p"),
        (1, 3, "u3", "f.pdf", 0, "", "", None, 0, 1, "x" * 1300, "", "", None, 0.4, 0.6, None),
    ]
    return spark.createDataFrame(rows, RESULT)


def test_build_context(spark):
    (row,) = context.build_context(results(spark)).collect()
    assert row.context == "\n\n---\n\n".join(
        [
            "[Data Act (2016/1) | Article 12a \u2014 Part 2/3 | Page 7]\nfirst",
            "[f.pdf | Annex IV | Page None]\nsecond",
            "[f.pdf | Page 0 | Page 0]\n" + "x" * 1300,
        ]
    )


def test_source_blocks(spark):
    (row,) = context.source_context(results(spark)).collect()
    first, second, third = row.context.split("\n\n")
    assert first == (
        "[Source 1]\nFile: f.pdf\nPage: 7\nArticle: 12a\nTitle: Aims\nRegulation: GDPR\nText:\nfirst"
    )
    assert second == (
        "[Source 2]\nFile: f.pdf\nPage: None\nArticle: None\nTitle: None\nRegulation: None\n"
        "Text:\nsecond"
    )
    assert "Page: 0\n" in third


def test_sources_are_previews(spark):
    rows = {r.source_index: r for r in context.sources(results(spark)).collect()}
    assert len(rows[3].text) == 1200 and rows[1].page == 7


def test_prompts_survive_without_results(spark):
    questions = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id bigint, question string")
    prompts = context.rag_prompts(questions, context.build_context(results(spark)))
    rows = {r.query_id: r for r in prompts.collect()}
    assert "why?" in rows[1].prompt and "second" in rows[1].prompt and rows[1].answer is None
    assert rows[2].prompt is None and rows[2].answer == context.NO_RESULTS_ANSWER


def test_answers_isolate_failing_rows(spark):
    prompts = spark.createDataFrame(
        [(1, "good", "c", "p1", None), (2, "bad", "c", "p2", None), (3, "none", "", None, "fixed")],
        "query_id bigint, question string, context string, prompt string, answer string",
    ).coalesce(1)

    def model(questions: pd.Series, prompts: pd.Series) -> pd.Series:
        if (questions == "bad").any():
            raise RuntimeError("no answer")
        return questions + "!"

    rows = {r.query_id: r for r in context.generate_answers(prompts, model).collect()}
    assert (rows[1].answer, rows[1].error) == ("good!", None)
    assert (rows[2].answer, rows[2].error) == (None, "RuntimeError: no answer")
    assert (rows[3].answer, rows[3].error) == ("fixed", None)
    good, bad = evaluate.split_failures(context.generate_answers(prompts, model))
    assert (good.count(), bad.count()) == (2, 1)


def test_ask_end_to_end(spark):
    pages = spark.createDataFrame(
        [("d", "d.pdf", 1, "Article 1\nRetention\nData shall be kept for ten days."),
         ("d", "d.pdf", 2, "Article 2\nPenalties\nFines may be imposed on operators.")],
        "document_id string, file_name string, page_number int, page_text string",
    )
    index = embed_chunks(rag.ingest(pages))
    questions = spark.createDataFrame([(5, "fines imposed on operators")], "query_id bigint, question string")
    (record,) = rag.ask(questions, index, lambda q, p: p.str.len().astype(str), 1).collect()
    (chunk,) = record.retrieved_chunks
    assert (chunk["rank"], chunk.chunk_uid) == (1, "d_art_2_p_0")
    assert chunk.metadata.source_file == "d.pdf" and chunk.metadata.page == 2
    assert "Penalties" in chunk.content and 0 <= chunk.distance < 1
    assert int(record.answer) > len(record.context)
    with pytest.raises(ValueError):
        rag.ask(questions, index, None, 21)
    blank = spark.createDataFrame([(5, "")], "query_id bigint, question string")
    with pytest.raises(ValueError, match="must not be empty"):
        rag.ask(blank, index, None)


def test_citations_and_links(spark):
    rows = [
        ("a", "x [Document: GDPR, Article 3, page 12] and [Source: f.pdf, Page 99, end] [Source: Excerpt #1]"),
        ("b", f"{INSUFFICIENT}. [Document: GDPR, page 12] [Source: Excerpt #1]"),
        ("c", "no citation [Documents: page 1]"),
    ]
    frame = spark.createDataFrame(rows, "answer_id string, answer string")
    cited = answers.extract_citations(frame)
    assert sorted((r.answer_id, r.position, r.page) for r in cited.collect() if r.answer_id == "a") == [
        ("a", 0, 12),
        ("a", 1, 99),
    ]
    assert {r.page for r in cited.where("answer_id = 'b'").collect()} == {None}
    assert cited.where("answer_id = 'c'").count() == 0
    retrieved = spark.createDataFrame(
        [("a", 1, 12, "old.pdf", "Old", "t"), ("a", 2, 12, "new.pdf", None, "Chunk"),
         ("a", 3, None, "none.pdf", "x", "y"), ("b", 1, 12, "b.pdf", None, None)],
        "answer_id string, rank int, page int, source_file string, regulation_title string, title string",
    )
    page_map = answers.citation_page_map(retrieved)
    assert sorted(tuple(r) for r in page_map.collect()) == [
        ("a", 12, "new.pdf", "Chunk"),
        ("b", 12, "b.pdf", ""),
    ]
    linked = {(r.answer_id, r.page): (r.file, r.linked) for r in answers.link_citations(cited, page_map).collect()}
    assert linked["a", 12] == ("new.pdf", True) and linked["a", 99] == (None, False)
    assert linked["b", None] == (None, False)
    assert [r.answer_id for r in answers.insufficient_answers(frame).collect()] == ["b"]


def test_scores(spark):
    contexts = spark.createDataFrame(
        [(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "query_id bigint, rank int, verdict int"
    )
    got = {r.query_id: r.context_precision for r in evaluate.context_precision(contexts).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 2), 2: 0.0}
    statements = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "query_id bigint, verdict int")
    assert evaluate.faithfulness(statements).collect()[0].faithfulness == pytest.approx(2 / 3)
    regenerated = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0]), (1, [1.0, 0.0], [0.0, 1.0])],
        "query_id bigint, query_vector array<double>, regenerated_vector array<double>",
    )
    scores = evaluate.evaluate_scores(statements, regenerated, contexts).collect()
    assert {(r.query_id, r.response_relevancy) for r in scores} == {(1, 0.5), (2, None)}


def test_search_summary_keeps_queries_without_hits(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    rows = report.search_summary(queries, results(spark)).collect()
    assert {(r.query_id, r.hits, r.top_score) for r in rows} == {(1, 3, 0.9), (2, 0, None)}


def test_failing_rows_are_found_by_halving(spark):
    """Two failing rows of 64 take a few calls for each halving, not one for each row."""
    calls = []

    def model(questions, prompts):
        calls.append(len(questions))
        if prompts.isin(["5", "40"]).any():
            raise ValueError("no")
        return questions

    rows = [str(i) for i in range(64)]
    found = context._asked(model, pd.Series(rows), pd.Series(rows))
    assert [i for i, (_, e) in enumerate(found) if e] == [5, 40]
    assert all(a == r for (a, e), r in zip(found, rows) if not e)
    assert len(calls) <= 2 * (2 * 6 + 1)
