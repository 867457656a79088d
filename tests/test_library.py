from __future__ import annotations

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lexweave.operators import intake
from lexweave.plans import library as lib
from lexweave.sinks import versions as vs

PAGES = "document_id string, file_name string, page_number int, page_text string, error string"
SCHEMA = "k string, n int, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def keyed(spark, tmp_path):
    """300 rows in 8 buckets, as version 1."""
    store = vs.Versions(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(f"k{i}", i, f"text {i}") for i in range(300)], SCHEMA)
    table = store.replaced(vs.empty_table(df.schema, ["k"], buckets=8), "g1", df)
    return store, store.commit(vs.Manifest(tables={"t": table})), df


def states(store, table):
    paths = [f"{store.root}/{p}" for found in table.files.values() for p in found]
    return {p: (os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in paths}


def test_only_files_with_an_affected_key_are_rewritten(spark, keyed):
    store, first, _ = keyed
    before = states(store, first.tables["t"])
    reader = store.read("t", first)
    time.sleep(0.05)
    incoming = spark.createDataFrame([("k7", 1000, "new"), ("fresh", 1, "added")], SCHEMA)
    gone = spark.createDataFrame([("k8",), ("never there",)], "k string")
    table = store.replaced(first.tables["t"], "g2", incoming, gone)
    # Nothing shows before the manifest does.
    assert store.manifest() == first and store.read("t").count() == 300
    second = store.commit(vs.replace(first, tables={"t": table}))
    after = states(store, table)
    kept = before.keys() & after.keys()
    assert len(before) - len(kept) <= 2 and all(before[p] == after[p] for p in kept)
    got = {r.k: (r.n, r.text) for r in store.read("t").collect()}
    assert len(got) == 300 and got["k7"] == (1000, "new") and got["fresh"] == (1, "added") and "k8" not in got
    # A reader of the version before still has all of it.
    assert reader.count() == 300 and {r.text for r in reader.where("k = 'k7'").collect()} == {"text 7"}
    assert second.version == 2 and store.numbers() == [1, 2]
    found = store.matching("t", spark.createDataFrame([("k7",), ("k8",)], "k string"), second)
    assert rows_of(found) == [("k7", 1000, "new")]


def test_of_two_writers_one_fails(spark, keyed):
    store, first, df = keyed
    store.commit(first)
    with pytest.raises(vs.Conflict):
        store.commit(first)
    assert store.read("t").count() == 300


def test_buckets_with_many_files_are_merged_and_old_files_expire(spark, keyed):
    store, manifest, _ = keyed
    for i in range(12):
        rows = spark.createDataFrame([(f"new{i}-{j}", i, "x") for j in range(30)], SCHEMA)
        table = store.replaced(manifest.tables["t"], f"g{i + 2}", rows)
        manifest = store.commit(vs.replace(manifest, tables={"t": table}))
    assert max(map(len, manifest.tables["t"].files.values())) <= vs.FILES_PER_BUCKET + 2
    want = rows_of(store.read("t"))
    assert len(want) == 300 + 12 * 30
    assert store.expire(keep=1) > 0
    assert store.numbers() == [manifest.version] and rows_of(store.read("t")) == want
    left = {os.path.join(d, f) for d, _, fs in os.walk(store.root) for f in fs if f.startswith("part-")}
    assert left == set(states(store, manifest.tables["t"]))


def test_null_keys_and_json_tables(spark, tmp_path):
    store = vs.Versions(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 3, None)], SCHEMA)
    table = store.replaced(vs.empty_table(df.schema, ["k"], "json", 4), "g1", df)
    first = store.commit(vs.Manifest(tables={"t": table}))
    assert rows_of(store.read("t")) == rows_of(df)
    table = store.replaced(table, "g2", spark.createDataFrame([(None, 9, "c")], SCHEMA))
    store.commit(vs.replace(first, tables={"t": table}))
    assert rows_of(store.read("t")) == [("x", 3, None), (None, 9, "c")]
    none = store.replaced(table, "g3", df.limit(0), df.select("k"))
    assert store.read_files(none, [p for f in none.files.values() for p in f]).count() == 0


GDPR = "REGULATION (EU) 2016/679 of 27 April 2016\nArticle 1\nSubject matter\nRules.\nArticle 2\nScope\nMore rules."


def extracted(spark, *documents):
    rows = [(d, f"{d}.pdf", 1, text, None if text is not None else "bad") for d, text in documents]
    return spark.createDataFrame(rows, PAGES)


def state(spark, library):
    """Index, chunk documents and registry, without times and runs."""
    index = library.read(spark, lib.INDEX).select("chunk_uid", "document_id", "chunk_text", "embedding")
    documents = library.read(spark, lib.CHUNK_JSON).select(
        "document_id", "chunk_count", F.col("chunks.chunk_uid").alias("uids"), F.col("chunks.text").alias("texts")
    )
    registry = library.read(spark, lib.REGISTRY).select("document_id", "source_pdf", "chunk_count")
    return rows_of(index), rows_of(documents), rows_of(registry)


def test_a_failed_run_shows_nothing_and_its_repetition_everything(spark, tmp_path, monkeypatch):
    clean = lib.Library(str(tmp_path / "clean"), 4)
    old = extracted(spark, ("a", "old text"), ("b", GDPR))
    new = extracted(spark, ("a", "new text"), ("c", "third"), ("d", None))
    lib.ingest_run(old, clean, "r1")
    shutil.copytree(clean.root, tmp_path / "first")
    _, failures = lib.ingest_run(new, clean, "r2")
    assert [r.document_id for r in failures.collect()] == ["d"]
    want = state(spark, clean)
    assert len(want[0]) == 4 and len(want[1]) == len(want[2]) == 3

    original = vs.Versions.replaced
    for step in range(4):
        library = lib.Library(str(tmp_path / f"failing{step}"), 4)
        shutil.copytree(tmp_path / "first", library.root)
        before = state(spark, library)
        calls = []

        def failing(self, *args, calls=calls, step=step, **options):
            table = original(self, *args, **options)
            calls.append(table)
            if len(calls) == step + 1:
                raise RuntimeError("lost")
            return table

        with monkeypatch.context() as patch:
            patch.setattr(vs.Versions, "replaced", failing)
            if step == 3:
                patch.setattr(vs.Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                lib.ingest_run(new, library, "r2")
        assert state(spark, library) == before
        lib.ingest_run(new, library, "r2")
        assert state(spark, library) == want


def test_a_repeated_run_replaces_what_it_took_in(spark, tmp_path):
    library = lib.Library(str(tmp_path / "store"), 4)
    lib.ingest_run(extracted(spark, ("a", GDPR), ("b", "kept")), library, "r1")
    lib.ingest_run(extracted(spark, ("c", "one"), ("d", "two")), library, "r2")
    lib.ingest_run(extracted(spark, ("c", "changed")), library, "r2")
    index, documents, registry = state(spark, library)
    assert [r[0] for r in registry] == ["a", "b", "c"] == [r[0] for r in documents]
    assert {r[1]: r[2] for r in index if r[1] != "a"} == {"b": "kept", "c": "changed"}
    lib.ingest_run(extracted(spark, ("z", "alone")), library, "r3", recreate=True)
    assert [[r[0] for r in part] for part in state(spark, library)] == [["z_chunk_0"], ["z"], ["z"]]
    manifest = library.versions(spark).manifest()
    assert manifest.version == 4 and list(manifest.runs) == ["r3"] and manifest.runs["r3"]["chunks"] == 1


def test_a_shorter_version_leaves_no_stale_chunk(spark, tmp_path):
    library = lib.Library(str(tmp_path / "store"), 4)
    lib.ingest_run(extracted(spark, ("a", GDPR), ("b", "x")), library, "r1")
    assert library.read(spark, lib.INDEX).count() == 3
    lib.ingest_run(extracted(spark, ("a", GDPR.split("\nArticle 2")[0]), ("b", "")), library, "r2")
    index, documents, registry = state(spark, library)
    assert [r[0] for r in index] == ["a_art_1_p_0"] and [r[0] for r in documents] == ["a"]
    assert [r[2] for r in registry] == [1, 0]


def pages(content):
    text = content.decode()
    if text.startswith("bad"):
        raise ValueError("unreadable")
    return text.split("\f")


def test_sync_takes_in_what_changed_and_removes_what_is_gone(spark, tmp_path):
    library = lib.Library(str(tmp_path / "store"), 4)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def encoder(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    encoder = encoder.asNondeterministic()

    def sync(run, **files):
        calls.value = 0
        df = spark.createDataFrame([(f"/in/{n}.pdf", bytearray(t.encode())) for n, t in files.items()], "path string, content binary")
        found, failures = lib.sync(df, library, run, pages, "stand-in", encoder)
        return {r.source_pdf[:-4]: r.status for r in found.collect()}, [r.document_id for r in failures.collect()], calls.value

    assert sync("r1", a=GDPR, b="same", c="to go", e="same") == ({"a": "new", "b": "new", "c": "new", "e": "new"}, [], 4)
    assert sync("r2", a=GDPR, b="same", c="to go", e="same") == ({"a": "same", "b": "same", "c": "same", "e": "same"}, [], 0)
    # Article 1 is as before: only the text of article 2 is encoded.
    changed = GDPR.replace("More rules.", "Other rules.")
    statuses, failures, encoded = sync("r3", a=changed, b="same", d="bad", e="same")
    assert (statuses, failures, encoded) == ({"a": "changed", "b": "same", "c": "gone", "d": "new", "e": "same"}, ["d"], 1)
    index, documents, registry = state(spark, library)
    assert [r[0] for r in registry] == ["a", "b", "e"] == [r[0] for r in documents]
    assert sorted(r[2] for r in index if r[1] != "a") == ["same", "same"]
    first, second = sorted(r[2] for r in index if r[1] == "a")
    assert first == "Article 1 Subject matter Rules." and second.endswith("Article 2 Scope Other rules.")
    assert sync("r4", a="bad now", b="same", d="good", e="same") == ({"a": "changed", "b": "same", "d": "new", "e": "same"}, ["a"], 1)
    assert [r[0] for r in state(spark, library)[2]] == ["a", "b", "d", "e"]


def test_reindex_from_chunk_documents(spark, tmp_path):
    library = lib.Library(str(tmp_path / "store"), 4)
    lib.ingest_run(extracted(spark, ("a", GDPR), ("b", "old")), library, "r1")
    lib.ingest_run(extracted(spark, ("b", "new")), library, "r2")
    want = state(spark, library)
    before = rows_of(library.read(spark, lib.INDEX).drop("embedding"))
    lib.reindex(spark, library, "again")
    assert state(spark, library) == want and rows_of(library.read(spark, lib.INDEX).drop("embedding")) == before


def test_changes(spark):
    listing = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, d string")
    known = spark.createDataFrame([("b", "2"), ("c", None), ("x", "1")], "k string, d string")
    got = {r.k: r.status for r in intake.changes(listing, known, "k", "d").collect()}
    assert got == {"a": "new", "b": "same", "c": "changed", "x": "gone"}
