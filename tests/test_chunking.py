from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweave.catalog import sql
from lexweave.functions import chunking as C
from lexweave.operators import documents as docs
from lexweave.operators.long_documents import chunk_long_documents, clean_blocks
from lexweave.functions.text import clean_text
from tests.random_texts import pages_of, texts


@pytest.mark.parametrize(
    "length, parts",
    [
        (900, [900]),
        (901, [900, 51]),
        (1700, [900, 850]),
        (1701, [900, 851, 1]),
        (1750, [900, 900, 50]),
    ],
)
def test_hard_split_lengths(evaluate, length, parts):
    text = "".join(chr(97 + i % 26) for i in range(length))
    out = evaluate(lambda X: C.hard_split(X), x=text)
    assert [len(p) for p in out] == parts
    assert all(p == text[i * 850 : i * 850 + 900] for i, p in enumerate(out))


def test_windows_count_code_points(evaluate):
    text = "\U0001d4b3\u00e9" * 800
    out = evaluate(lambda X: C.windows(X, 900, 150), x=text)
    assert out == [text[s : s + 900] for s in range(0, 1600, 750)]


def test_windows_of_nothing(evaluate):
    assert evaluate(lambda X: C.windows(X, 900, 150), x="") == []


def test_split_body_annex(evaluate):
    out = evaluate(lambda X: C.split_body_annex(X), x="body \n\n ANNEX I\na\nANNEX II\nb ")
    assert (out["body"], out["annex"]) == ("body", "ANNEX I\na\nANNEX II\nb")
    out = evaluate(lambda X: C.split_body_annex(X), x="ANNEXED is no annex\nannex neither")
    assert out["annex"] == ""


def chunks_of(spark, text):
    rows = spark.createDataFrame([("d", "d.pdf", text)], "document_id string, file_name string, full_text string")
    return docs.chunk_documents(rows).orderBy("chunk_id").collect()


def test_preamble_is_dropped_and_later_articles_overlap(spark):
    before = "Recital text that is long enough to be more than fifty characters in all.\n"
    text = before + "Article 1\nScope\nFirst body.\nArticle 2\nAims\nSecond body."
    first, second = chunks_of(spark, text)
    assert first.chunk_text == "Article 1 Scope First body."
    overlap = (before + "Article 1\nScope\nFirst body.\n")[-50:]
    assert second.chunk_text == " ".join((overlap + "Article 2 Aims Second body.").split())
    assert (first.title, second.title) == ("Scope", "Aims")
    assert (first.chunk_uid, second.chunk_uid) == ("d_art_1_p_0", "d_art_2_p_0")


@pytest.mark.parametrize(
    "article, title",
    [
        ("Article 1\n1. text\nScope", "Scope"),
        ("Article 1\n(1) text\nL 1/2\nEN\nScope", None),
        ("Article 1", None),
        ("Article 1\n" + "x" * 151 + "\nshort", "short"),
        ("Article 1\r\n\x0bScope", "Scope"),
    ],
)
def test_article_title(evaluate, article, title):
    assert evaluate(lambda X: C.article_title(X), x=article) == title


def test_annex_without_number(spark):
    (chunk,) = [c for c in chunks_of(spark, "Article 1\nx\nANNEX") if c.chunk_type == "annex"]
    assert (chunk.annex_number, chunk.title, chunk.chunk_uid) == (None, "Annex", "d_chunk_1")


def test_oversized_article_repeats_its_header(spark):
    text = "Article 7\nDuties\n" + "\n".join(f"{i}. " + "word " * 60 for i in range(1, 8))
    chunks = chunks_of(spark, text)
    assert len(chunks) > 1
    assert all(c.chunk_text.startswith("Article 7 Duties") for c in chunks)
    assert {c.part_count for c in chunks} == {len(chunks)}
    assert [c.chunk_uid for c in chunks] == [f"d_art_7_p_{i}" for i in range(len(chunks))]


def test_oversized_first_paragraphs_stay_together(evaluate):
    article = "Article 1\n" + "a" * 700 + "\n1. " + "b" * 700
    parts = evaluate(lambda X: C.split_oversized(X, F.lit("1"), F.lit(None).cast("string")), x=article)
    assert parts == [article[0:900], article[850:1750]]


def test_empty_and_null_texts_give_no_chunks(spark):
    assert chunks_of(spark, "") == [] == chunks_of(spark, None) == chunks_of(spark, " \nEN\n ")


def test_fallback_windows(spark):
    text = "word " * 400
    chunks = chunks_of(spark, text)
    stripped = text.strip()
    assert [c.chunk_text for c in chunks] == [stripped[s : s + 900].strip() for s in range(0, 1999, 750)]
    assert {(c.chunk_type, c.part_index, c.part_count) for c in chunks} == {("fallback", 0, 1)}


def rows_of(df):
    names = sorted(c for c in df.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def test_random_documents_agree_with_sql(spark):
    rows = [(f"d{i}", f"d{i}.pdf", t) for i, t in enumerate(texts(300, seed=11))]
    got = docs.chunk_documents(
        spark.createDataFrame(rows, "document_id string, file_name string, full_text string")
    )
    con = duckdb.connect()
    con.register("randoms", pd.DataFrame(rows, columns=["document_id", "file_name", "full_text"]))
    query = sql.with_(sql.chunks("randoms")) + "SELECT * FROM chunks"
    cursor = con.execute(query)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got) == want
    assert len(want) > 500


def random_pages(spark, count, seed):
    rng = random.Random(seed)
    rows = []
    for i, document in enumerate(texts(count, seed)):
        document = document.replace("double  space", "nbsp\u00a0\u2003space")
        for number, page in enumerate(pages_of(document, rng), start=1):
            rows.append((f"d{i}", f"d{i}.pdf", number, page))
    return spark.createDataFrame(
        rows, "document_id string, file_name string, page_number int, page_text string"
    )


@pytest.mark.parametrize("block_pages", [1, 3])
def test_blocks_join_to_the_cleaned_text(spark, block_pages):
    pages = random_pages(spark, 150, seed=5).cache()
    blocks = clean_blocks(pages, block_pages)
    joined = (
        blocks.groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"))
        .select("document_id", F.array_join("b.text", "\n").alias("joined"))
    )
    whole = docs.document_text(pages).select(
        "document_id", clean_text(F.col("full_text")).alias("whole")
    )
    both = whole.join(joined, "document_id").collect()
    assert len(both) == 150
    assert [r.document_id for r in both if r.whole != r.joined] == []
    assert blocks.count() > 400


@pytest.mark.parametrize("block_pages, seed", [(1, 21), (2, 22), (5, 23)])
def test_long_documents_get_the_same_chunks(spark, block_pages, seed):
    pages = random_pages(spark, 250, seed).cache()
    columns = ["document_id", "chunk_id", "c.*"]
    got = chunk_long_documents(pages, block_pages).select(*columns)
    want = docs.chunk_documents(docs.document_text(pages)).select(
        "document_id", "chunk_id", *[c for c in got.columns if c not in ("document_id", "chunk_id")]
    )
    assert rows_of(got) == rows_of(want)


def test_long_and_short_paths_tag_the_same_pages(spark, monkeypatch):
    monkeypatch.setattr(docs, "EARLY_PAGES", 2)
    pages = random_pages(spark, 120, seed=31).cache()
    want = docs.silver_chunks(pages)
    assert rows_of(docs.silver_chunks(pages, in_row_chars=0)) == rows_of(want)
    assert rows_of(docs.silver_chunks(pages, in_row_chars=2000)) == rows_of(want)
    untagged = docs.chunk_documents(docs.document_text(pages))
    for limit in (0, 2000, docs.IN_ROW_CHARS):
        tagged = docs.tag_pages(untagged, pages, limit)
        assert rows_of(tagged) == rows_of(want.drop("law_passed_date"))
    assert want.where("page_number IS NULL").count() > 0


def test_paths_agree_on_gaps_files_of_one_stem_and_missing_pages(spark, monkeypatch):
    monkeypatch.setattr(docs, "EARLY_PAGES", 2)
    pages = random_pages(spark, 40, seed=33)
    other = random_pages(spark, 40, seed=34).withColumn("file_name", F.lit("other.pdf"))
    pages = pages.unionByName(other).withColumn(
        "page_text", F.when(F.col("page_number") % 5 != 4, F.col("page_text"))
    )
    pages = pages.withColumn("page_number", (F.col("page_number") * 3 + 2).cast("int")).cache()
    want = docs.silver_chunks(pages)
    assert rows_of(docs.silver_chunks(pages, in_row_chars=0)) == rows_of(want)
    untagged = docs.chunk_documents(docs.document_text(pages))
    for limit in (0, 2000, docs.IN_ROW_CHARS):
        tagged = docs.tag_pages(untagged, pages, limit)
        assert rows_of(tagged) == rows_of(want.drop("law_passed_date"))


def test_page_of_the_longest_prefix_wins(evaluate):
    mark = "x" * 60 + "y" * 60 + "z" * 100
    pages = ["a " + mark[:50], mark + " tail", "nothing", "again " + mark]

    def page(X):
        return C.locate_page(X, F.array(*[F.lit(p) for p in pages]))

    assert evaluate(page, x=mark) == 2
    assert evaluate(page, x=mark[:50] + "!") == 1
    assert evaluate(page, x="") is None


@pytest.mark.parametrize(
    "text, kind, article, annex, part, expected",
    [
        ("end of previous Article 1 Scope", "article", "1", None, 0, "article 1 scope"),
        ("Article 12 x Article 1 y", "article", "1", None, 0, "article 12 x article 1 y"),
        ("Article 1 Scope (a) Point", "article", "1", None, 1, "(a) point"),
        ("no paragraph", "article", "1", None, 1, "no paragraph"),
        ("x ANNEX II y", "annex", None, "II", 0, "annex ii y"),
        ("Fall  back", "fallback", None, None, 0, "fall back"),
    ],
)
def test_fingerprint(spark, text, kind, article, annex, part, expected):
    row = spark.createDataFrame(
        [(text, kind, article, annex, part)], "t string, k string, a string, x string, p int"
    )
    mark = C.fingerprint(*[F.col(c) for c in ("t", "k", "a", "x", "p")])
    assert row.select(mark.alias("m")).collect()[0].m == expected


def test_repeated_headings_repeat_the_uid(spark):
    uids = [c.chunk_uid for c in chunks_of(spark, "Article 1\na\nArticle 1\nb")]
    assert uids == ["d_art_1_p_0", "d_art_1_p_0"]


def test_missing_page_text_counts_as_empty(spark):
    pages = spark.createDataFrame(
        [("d", "f", 2, None), ("d", "f", 1, "a"), ("d", "f", 3, "b")],
        "document_id string, file_name string, page_number int, page_text string",
    )
    assert docs.document_text(pages).collect()[0].full_text == "a\n\nb"


def test_limit_and_order(spark):
    pages = random_pages(spark, 10, seed=3)
    chunks = docs.chunk_documents(docs.document_text(pages))
    assert {r.chunk_id for r in docs.limit_chunks(chunks).collect()} == {0}
    ordered = docs.ordered_scan(pages, ("document_id", "page_number")).collect()
    assert ordered == sorted(ordered, key=lambda r: (r.document_id, r.page_number))
