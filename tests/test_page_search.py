"""Page numbers of long documents: the search itself, and what it writes to disk."""

from __future__ import annotations

import contextlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lexweave.operators import documents as docs
from lexweave.operators import page_search
from lexweave.operators.long_documents import first_ids, long_units, numbered_chunks
from tests.test_chunking import random_pages, rows_of


def _brute(groups, texts, pages):
    out, total = [], sum(len(p[2]) + 1 for p in pages)
    for group, text in zip(groups, texts, strict=True):
        best, offset = total, 0
        for page in pages:
            at = page[2].find(text) if page[0] == group else -1
            best = min(best, offset + at) if at >= 0 else best
            offset += len(page[2]) + 1
        out.append(best)
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc d", "aé\U0001d4b3\x00"])
@pytest.mark.parametrize("base", [page_search._BASE, 1])
def test_first_positions_equal_a_brute_force(monkeypatch, alphabet, base):
    """Also where every order of the same letters hashes alike (base 1)."""
    monkeypatch.setattr(page_search, "_BASE", base)
    monkeypatch.setattr(page_search, "_powers", {})
    monkeypatch.setattr(page_search, "CANDIDATES", 7)
    rng = random.Random(len(alphabet))
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(25):
        groups = rng.randint(1, 3)
        pages = [(g, i, text(rng.randint(1, 300))) for g in range(groups) for i in range(rng.randint(1, 3))]
        sought = set()
        for _ in range(30):
            page = rng.choice(pages)[2]
            at = rng.randrange(len(page))
            sought.add((rng.randrange(groups), page[at : at + rng.randint(1, 200)] + rng.choice(("", "", "?"))))
        of, texts = zip(*sorted(sought), strict=True)
        assert page_search.first_positions(of, texts, pages).tolist() == _brute(of, texts, pages)


class _Disk:
    """The most bytes of shuffle files, and of tables in the shared folder, seen while it is open."""

    def __init__(self, spark):
        context = spark.sparkContext
        manager = context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        self.folders = [d.getPath() for d in manager.localDirs()]
        self.folders.append(spark.conf.get("spark.checkpoint.dir"))
        self.most, self.over = 0, threading.Event()

    def _bytes(self):
        total = 0
        for folder in self.folders:
            for path, _, names in os.walk(folder):
                for name in names:
                    if name.startswith(("shuffle_", "temp_shuffle_", "part-")):
                        with contextlib.suppress(OSError):
                            total += os.stat(f"{path}/{name}").st_size
        return total

    def _watch(self):
        while not self.over.wait(0.02):
            self.most = max(self.most, self._bytes() - self.before)

    def __enter__(self):
        self.before = self._bytes()
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def _long_pages(spark, documents, pages):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    rows = [
        (f"d{d}", f"d{d}.pdf", p, f"Article {p}\n" + " ".join(rng.choice(words) for _ in range(110)))
        for d in range(documents)
        for p in range(1, pages + 1)
    ]
    return spark.createDataFrame(
        rows, "document_id string, file_name string, page_number int, page_text string"
    ), sum(len(r[3]) for r in rows)


def test_tagging_writes_a_few_times_its_texts(spark, monkeypatch):
    """Also with more sought texts than are broadcast, when every position of a page went to them."""
    monkeypatch.setattr(docs, "MAX_BROADCAST_TEXTS", 0, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages, chars = _long_pages(spark, 20, 30)
        pages = pages.cache()
        chunks = docs.chunk_documents(docs.document_text(pages)).cache()
        assert chunks.count() >= 600
        with _Disk(spark) as disk:
            tagged = docs.tag_pages(chunks, pages, 0)
            found = tagged.where(F.col("page_number").isNotNull()).count()
        assert disk.most < 8 * chars
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == chunks.count()


@pytest.mark.parametrize("slice_chars", [docs.SLICE_CHARS, 100_000])
def test_long_documents_write_a_few_times_their_texts(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(docs, "SLICE_CHARS", slice_chars)
    pages, chars = _long_pages(spark, 40, 90)
    pages = pages.cache()
    want = rows_of(docs.silver_chunks(pages))
    with _Disk(spark) as disk:
        got = rows_of(docs.silver_chunks(pages, in_row_chars=0))
    assert got == want
    assert disk.most < 4 * chars


def test_slices_of_documents_give_the_same_chunks(spark, monkeypatch):
    """Also where articles, annexes and texts without headings span blocks."""
    pages = random_pages(spark, 60, seed=41).cache()
    want = docs.chunk_documents(docs.document_text(pages))
    units = long_units(pages, block_pages=2, slices=3)
    got = numbered_chunks(units, first_ids(units), F.col("chunks")).select(
        "document_id", "chunk_id", "c.*"
    )
    assert rows_of(got) == rows_of(want.select(*got.columns))
    assert units.where("unit < 0").count() > 50
    monkeypatch.setattr(docs, "SLICE_CHARS", 1000)
    assert rows_of(docs.silver_chunks(pages, in_row_chars=0)) == rows_of(docs.silver_chunks(pages))


def test_documents_all_short_all_long_and_without_an_id(spark):
    pages = random_pages(spark, 6, seed=43).withColumn(
        "document_id", F.when(F.col("document_id") != "d3", F.col("document_id"))
    ).cache()
    want = rows_of(docs.silver_chunks(pages))
    for limit, parts in ((docs.IN_ROW_CHARS, (True, False)), (0, (True, True))):
        assert tuple(p is not None for p in docs.split_by_length(pages, limit)) == parts
        assert rows_of(docs.silver_chunks(pages, limit)) == want
    named = pages.where("document_id IS NOT NULL")
    assert docs.split_by_length(named, 0)[0] is None
    assert rows_of(docs.silver_chunks(named, 0)) == rows_of(docs.silver_chunks(named))
