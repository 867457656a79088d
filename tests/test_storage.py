from __future__ import annotations

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from lexweave import schemas, storage
from lexweave.operators import enrich
from lexweave.plans import medallion, rag
from lexweave.sinks import files as file_sinks
from lexweave.sinks import tables as table_sinks
from lexweave.sources import files, tables
from lexweave.sources.tables import Target

PAGES = "document_id string, file_name string, page_number int, page_text string"
GDPR = (
    "REGULATION (EU) 2016/679 OF THE EUROPEAN PARLIAMENT AND OF THE COUNCIL\n"
    "of 27 April 2016\n(General Data Protection Regulation)\nArticle 1\nSubject matter\nRules."
)


def read_pages(content: bytes) -> list[str]:
    text = content.decode()
    if text.startswith("broken"):
        raise ValueError("not a document")
    return text.split("\f")


@pytest.fixture
def pdf_dir(tmp_path):
    folder = tmp_path / "pdfs"
    folder.mkdir()
    (folder / "32016R0679_EN.pdf").write_text(GDPR + "\fArticle 2\nScope\nMore rules.")
    (folder / "my file.v2.pdf").write_text("plain text without structure")
    (folder / "bad.pdf").write_text("broken")
    (folder / "notes.txt").write_text("not a pdf")
    return str(folder)


@pytest.fixture
def target(spark):
    return Target(f"t_{uuid.uuid4().hex}")


def test_bronze_lists_pdf_files_without_reading_them(spark, pdf_dir):
    rows = files.bronze_documents(spark, pdf_dir, "/vol")
    got = {r.document_id: r for r in rows.collect()}
    assert set(got) == {"32016R0679_EN", "my file.v2", "bad"}
    gdpr = got["32016R0679_EN"]
    assert (gdpr.regulation_family, gdpr.source_path) == ("GDPR", "/vol/32016R0679_EN.pdf")
    assert (gdpr.source_name, gdpr.file_type, gdpr.status) == ("EUR-Lex", "pdf", "new")
    assert got["bad"].regulation_family is None
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_empty_directory_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no PDF files"):
        files.bronze_documents(spark, str(tmp_path), "/vol")


def test_extract_pages_isolates_failures(spark, pdf_dir):
    pages = files.extract_pages(files.read_files(spark, pdf_dir), read_pages, "stand-in")
    rows = {(r.document_id, r.page_number): r for r in pages.collect()}
    assert rows["32016R0679_EN", 2].page_text == "Article 2\nScope\nMore rules."
    assert rows["32016R0679_EN", 2].char_count == len("Article 2\nScope\nMore rules.")
    assert rows["bad", 1].error == "ValueError: not a document"
    chunks, failures = rag.split_ingest(pages)
    assert {r.document_id for r in failures.collect()} == {"bad"}
    meta = chunks.where("article_number = '2'").collect()[0]
    assert meta.regulation_title == "General Data Protection Regulation"
    assert meta.law_passed_date == datetime.date(2016, 4, 27)
    assert (meta.page_number, meta.chunk_uid) == (2, "32016R0679_EN_art_2_p_0")


def test_build_from_directory(spark, pdf_dir, target):
    counts, failures = medallion.build_from_directory(
        spark, target, pdf_dir, read_pages, "stand-in"
    )
    assert [r.document_id for r in failures.collect()] == ["bad"]
    assert {r.table_name: r.row_count for r in counts.collect()} == {
        "bronze_raw_documents": 3,
        "silver_extracted_pages": 3,
        "silver_chunks": 3,
        "gold_ai_ready_chunks": 3,
        "gold_embedded_chunks": 3,
    }
    embedded = spark.table(target.table("gold_embedded_chunks"))
    assert embedded.schema == schemas.TABLES["gold_embedded_chunks"]
    assert embedded.where("embedded_at IS NULL OR ingested_at IS NULL").count() == 0
    gold = embedded.where("document_id = '32016R0679_EN'").collect()
    assert {(r.regulation_family, str(r.law_passed_date)) for r in gold} == {("GDPR", "2016-04-27")}
    log = spark.table(target.table("pipeline_run_log")).collect()
    assert {(r.step_name, r.status, r.row_count) for r in log} == {
        *((s, "ok", 3) for s in ("bronze", "pages", "chunks", "gold", "embeddings")),
        ("extract", "failed", 0),
    }
    (lost,) = [r.message for r in log if r.step_name == "extract"]
    assert lost.startswith("bad") and lost.endswith("ValueError: not a document")


def test_failed_step_is_logged_and_raised(spark, target):
    documents = spark.createDataFrame([], "document_id string, file_name string")
    pages = spark.createDataFrame([], schemas.PAGES)
    with pytest.raises(ValueError, match="no extracted pages"):
        medallion.build(spark, target, documents, pages)
    log = {r.step_name: r for r in spark.table(target.table("pipeline_run_log")).collect()}
    assert log["chunks"].status == "failed" and "no extracted pages" in log["chunks"].message
    with pytest.raises(ValueError, match="is empty"):
        medallion.write_embeddings(spark, target)


def test_create_and_recreate_tables(spark, target):
    table_sinks.create_tables(spark, target)
    table_sinks.create_tables(spark, target)
    for name, schema in schemas.TABLES.items():
        assert spark.table(target.table(name)).schema == schema
    name = "silver_extracted_pages"
    page = spark.createDataFrame([("d", "f", 1, "x", 1, "m", None)], schemas.TABLES[name])
    assert table_sinks.overwrite_table(page, target, name) == 1
    table_sinks.recreate_table(spark, target, name)
    assert spark.table(target.table(name)).count() == 0
    spark.sql(f"DROP TABLE {target.table(name)}")
    table_sinks.recreate_table(spark, target, name)
    assert spark.table(target.table(name)).schema == schemas.TABLES[name]


def test_upsert_keeps_the_last_of_a_key(spark):
    schema = "chunk_uid string, chunk_id int, text string"
    old = spark.createDataFrame([("a", 9, "old a"), ("b", 1, "old b")], schema)
    new = spark.createDataFrame([("a", 1, "first"), ("a", 2, None), ("c", 1, "c")], schema)
    merged = table_sinks.upsert(old, new, "chunk_uid", F.col("chunk_id"))
    assert sorted(tuple(r) for r in merged.collect()) == [
        ("a", 2, None),
        ("b", 1, "old b"),
        ("c", 1, "c"),
    ]


def test_swap_table_may_read_what_it_replaces(spark, target):
    spark.sql(f"CREATE SCHEMA {target.namespace}")
    first = spark.range(3).withColumnRenamed("id", "n")
    assert table_sinks.swap_table(first, target, "numbers") == 3
    grown = spark.table(target.table("numbers")).unionByName(first)
    assert table_sinks.swap_table(grown, target, "numbers") == 6
    assert spark.table(target.table("numbers")).count() == 6


def chunk_rows(spark, n):
    rows = [(f"u{i}", "d", i, None, "fallback", None, None, None, 0, 1, f"text {i} \u00e9") for i in range(n)]
    return spark.createDataFrame(
        rows,
        "chunk_uid string, document_id string, chunk_id int, page_number int, chunk_type string, "
        "article_number string, annex_number string, title string, part_index int, "
        "part_count int, chunk_text string",
    )


def test_chunk_json_round_trip_in_sections(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_sinks, "CHUNKS_PER_JSON", 4)
    header = spark.createDataFrame(
        [("d", "d.pdf", None, "2016/1", None, None)],
        "document_id string, source_pdf string, regulation_title string, "
        "document_version string, issuing_authority string, law_passed_date date",
    )
    documents = file_sinks.chunk_documents_json(
        chunk_rows(spark, 10), header, F.to_date(F.lit("2016-04-27"))
    )
    path = str(tmp_path / "json")
    file_sinks.write_chunk_json(documents, path)
    text = spark.read.text(path).collect()
    assert [r.piece for r in documents.orderBy("piece").collect()] == [0, 1, 2]
    assert len(text) == 3 and all('"regulation_title":null' in r.value for r in text)
    assert any("\u00e9" in r.value for r in text)
    back = tables.chunk_json_source(spark, path).orderBy("chunk_id").collect()
    assert [r.chunk_uid for r in back] == [f"u{i}" for i in range(10)]
    assert {(str(r.law_passed_date), r.document_version) for r in back} == {("2016-04-27", "2016/1")}
    assert back[3].char_length == len("text 3 \u00e9")


def test_multi_line_chunk_json(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(
        '{"document_id": "d",\n "law_passed_date": "2016-04-27",\n'
        ' "chunks": [{"chunk_uid": "u", "chunk_id": 0, "text": "abc", "char_length": 99}]}'
    )
    (row,) = tables.chunk_json_source(spark, str(path), multi_line=True).collect()
    assert (row.char_length, row.part_index, row.part_count) == (3, 0, 1)


def test_document_text_round_trip(spark, tmp_path):
    pages = [("a", 2, "two\nlines\n"), ("a", 1, "one"), ("b", 1, None), ("a", 10, "")]
    path = str(tmp_path / "text")
    frame = spark.createDataFrame(pages, "document_id string, page_number int, page_text string")
    file_sinks.write_document_text(frame, path)
    got = {r.document_id: r.full_text for r in file_sinks.read_document_text(spark, path).collect()}
    assert got == {"a": "one\ntwo\nlines\n\n", "b": ""}


def test_eval_csv_writes_nothing_without_rows(spark, tmp_path):
    path = tmp_path / "eval"
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in schemas.EVAL_COLUMNS))
    assert file_sinks.write_eval_csv(empty, str(path)) is False
    assert not path.exists()


def test_golden_dataset(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text('[{"act": "GDPR",\n "question": "q?", "ground_truth": "t", "extra": 1}]')
    assert [tuple(r) for r in tables.golden_dataset(spark, str(path)).collect()] == [("GDPR", "q?", "t")]


def test_every_file_has_one_registry_row(spark):
    """Files of one stem, and files whose first page has another number than 1."""
    rows = [("a", "a.pdf", 3, GDPR), ("a", "a.pdf", 7, "more"), ("a", "a.txt", 1, "x"), ("b", "b.pdf", 2, None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = rag.registry_rows(pages, rag.ingest(pages)).collect()
    assert sorted((r.document_id, r.source_pdf, r.document_version) for r in got) == [
        ("a", "a.pdf", "2016/679"),
        ("a", "a.txt", ""),
        ("b", "b.pdf", ""),
    ] or sorted((r.document_id, r.source_pdf, r.document_version or "") for r in got) == [
        ("a", "a.pdf", "2016/679"),
        ("a", "a.txt", ""),
        ("b", "b.pdf", ""),
    ]
    assert {r.source_pdf: r.chunk_count for r in got}["a.pdf"] == 1


def test_strict_conform_ends_the_job(spark):
    raw = spark.createDataFrame([("1", "x")], "chunk_id string, page_number string")
    with pytest.raises(Exception, match="page_number is no int: x"):
        schemas.conform(raw, schemas.TABLES["silver_chunks"], strict=True).collect()


def test_registry_grows_and_known_sources_are_skipped(spark, tmp_path):
    path = str(tmp_path / "registry")
    pages = spark.createDataFrame([("a_EN", "a_EN.pdf", 1, GDPR), ("b_EN", "b_EN.pdf", 1, "x")], PAGES)
    rows = rag.registry_rows(pages, rag.ingest(pages))
    file_sinks.append_registry(rows.where("document_id = 'a_EN'"), path)
    registry = tables.registry(spark, path)
    assert [r.document_id for r in enrich.skip_known(rows, registry, "document_id").collect()] == ["b_EN"]
    assert [r.document_id for r in enrich.known(rows, registry, "document_id").collect()] == ["a_EN"]
    file_sinks.append_registry(rows.where("document_id = 'b_EN'"), path)
    assert {r.document_id: r.chunk_count for r in registry.select("*").collect()}.keys() >= {"a_EN"}
    assert tables.registry(spark, path).count() == 2


def test_json_registry(spark, tmp_path):
    path = tmp_path / "documents.json"
    path.write_text('[{"document_id": "a",\n "chunk_count": 3}, {"document_id": "b"}]')
    rows = tables.registry(spark, str(path), "json").collect()
    assert {(r.document_id, r.chunk_count) for r in rows} == {("a", 3), ("b", None)}


def test_ingest_into_a_store_twice(spark, target, tmp_path):
    spark.sql(f"CREATE SCHEMA {target.namespace}")
    store = rag.Store(target, str(tmp_path / "json"), str(tmp_path / "registry"))

    def extracted(*rows):
        return spark.createDataFrame(
            [(d, f"{d}.pdf", 1, text, error) for d, text, error in rows], f"{PAGES}, error string"
        )

    first = extracted(("a", GDPR, None), ("b", "old text", None), ("c", None, "unreadable"))
    assert [r.document_id for r in rag.ingest_into(first, store).collect()] == ["c"]
    rag.ingest_into(extracted(("b", "new text", None)), store)
    index = spark.table(target.table("chunk_index"))
    assert {r.chunk_uid: r.chunk_text for r in index.collect()} == {
        "a_art_1_p_0": "Article 1 Subject matter Rules.",
        "b_chunk_0": "new text",
    }
    assert tables.registry(spark, store.registry_dir).count() == 3
    assert tables.chunk_json_source(spark, f"{store.json_dir}/*").count() == 3
    # Of the two generations of ``b`` in the JSON the later one counts, in any order of files.
    rag.reindex(spark, store)
    index = spark.table(target.table("chunk_index"))
    assert {r.chunk_uid: r.chunk_text for r in index.collect()}["b_chunk_0"] == "new text"
    rag.ingest_into(extracted(("d", "more", None)), store, recreate=True)
    assert [r.chunk_uid for r in spark.table(target.table("chunk_index")).collect()] == ["d_chunk_0"]
    assert [r.document_id for r in tables.registry(spark, store.registry_dir).collect()] == ["d"]
    assert [r.document_id for r in tables.chunk_json_source(spark, f"{store.json_dir}/*").collect()] == ["d"]


def test_source_manifest(spark):
    rows = spark.createDataFrame([("32016R0679_EN",)], "document_id string")
    (row,) = files.source_manifest(rows).collect()
    assert (row.celex_id, row.language) == ("32016R0679", "EN")
    assert row.url == "https://eur-lex.europa.eu/legal-content/EN/TXT/PDF/?uri=CELEX:32016R0679"


def test_conform_casts_leniently(spark):
    raw = spark.createDataFrame([("1", "x", "2016-04-27")], "chunk_id string, page_number string, law_passed_date string")
    row = schemas.conform(raw, schemas.TABLES["silver_chunks"]).collect()[0]
    assert (row.chunk_id, row.page_number, row.law_passed_date) == (1, None, datetime.date(2016, 4, 27))


def test_gold_keeps_chunks_of_unknown_documents(spark):
    chunks = chunk_rows(spark, 2).withColumn("file_name", F.lit("f"))
    documents = spark.createDataFrame(
        [("other", "p", "s", "r")],
        "document_id string, source_path string, source_name string, regulation_family string",
    )
    assert {r.source_path for r in enrich.gold_chunks(chunks, documents).collect()} == {None}


def test_shared_dir_is_the_configured_one(spark):
    assert storage.new_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(5)
    again = storage.materialize(df, "range")
    assert sorted(r.id for r in again.collect()) == list(range(5))
    with pytest.raises(ValueError, match="nothing here"):
        storage.require_rows(df.limit(0), "nothing here")


def test_document_text_shares_files_between_documents(spark, tmp_path):
    path = str(tmp_path / "text")
    rows = [(f"d/{i}=ü", page, f"{i} {page}\r\n") for i in range(40) for page in (10, 2, 1)]
    frame = spark.createDataFrame(rows, "document_id string, page_number int, page_text string")
    file_sinks.write_document_text(frame, path)
    written = list((tmp_path / "text").iterdir())
    assert not [f for f in written if f.is_dir()]
    assert len([f for f in written if f.suffix == ".json"]) < 40
    got = {r.document_id: r.full_text for r in file_sinks.read_document_text(spark, path).collect()}
    assert got == {
        f"d/{i}=ü": "\n".join(f"{i} {page}\r\n" for page in (1, 2, 10)) for i in range(40)
    }


def test_ingest_a_directory(spark, pdf_dir, target, tmp_path):
    spark.sql(f"CREATE SCHEMA {target.namespace}")
    store = rag.Store(target, str(tmp_path / "json"), str(tmp_path / "registry"))
    text_dir = str(tmp_path / "text")
    summary, failures = rag.ingest_directory(
        spark, pdf_dir, store, read_pages, "stand-in", text_dir
    )
    index = spark.table(target.table("chunk_index"))
    assert [r.document_id for r in failures.collect()] == ["bad"]
    texts = file_sinks.read_document_text(spark, f"{text_dir}/*").collect()
    assert {r.document_id: r.chars for r in summary.collect()} == {
        r.document_id: len(r.full_text) for r in texts
    }
    assert sum(r.chunks for r in summary.collect()) == index.count() > 0

    known = tables.registry(spark, store.registry_dir)
    again, failures = rag.ingest_directory(
        spark, pdf_dir, store, read_pages, "stand-in", text_dir, known=known
    )
    assert again.isEmpty() and [r.document_id for r in failures.collect()] == ["bad"]
    assert tables.registry(spark, store.registry_dir).count() == len(texts)
