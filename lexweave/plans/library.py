"""A store of documents whose parts change together.

Chunk documents, index and registry are tables of one ``Versions`` folder.  A run writes
files for each of them and then one manifest, so all three show the run or none does.  A
run that failed leaves files nobody lists, and taking it up again under its id gives what
one clean run gives; a run that is repeated replaces what it had taken in.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from lexweave import schemas
from lexweave.functions.vectors import hash_embedding
from lexweave.operators.embed import Encoder
from lexweave.operators.intake import CHANGED, GONE, NEW, changes, content_digest
from lexweave.plans import rag
from lexweave.sinks.files import chunk_documents_json
from lexweave.sinks.versions import BUCKETS, Manifest, Table, Versions, empty_table
from lexweave.sources.files import PageExtractor, extract_pages, file_name
from lexweave.sources.tables import chunks_of_documents
from lexweave.storage import materialize

INDEX, CHUNK_JSON, REGISTRY = "index", "chunk_json", "registry"
_FILE = ["document_id", "source_pdf"]

REGISTRY_SCHEMA = StructType(
    [
        *schemas.REGISTRY.fields,
        StructField("content_digest", StringType()),
        StructField("run_id", StringType()),
    ]
)
_FIELDS = {
    f.name: f
    for f in (*schemas.TABLES["gold_ai_ready_chunks"].fields, *schemas.CHUNK_DOCUMENT.fields)
}
INDEX_SCHEMA = StructType(
    [
        *[_FIELDS[c] for c in rag.CHUNK_COLUMNS],
        StructField("text_digest", StringType()),
        StructField("embedding", ArrayType(FloatType())),
    ]
)


@dataclass(frozen=True)
class Library:
    """A folder that driver and executors share, and the number of buckets of its tables."""

    root: str
    buckets: int = BUCKETS

    def tables(self) -> dict[str, Table]:
        return {
            CHUNK_JSON: empty_table(schemas.CHUNK_DOCUMENT, _FILE, "json", self.buckets),
            INDEX: empty_table(INDEX_SCHEMA, ["chunk_uid"], "parquet", self.buckets),
            REGISTRY: empty_table(REGISTRY_SCHEMA, _FILE, "parquet", self.buckets),
        }

    def versions(self, spark: SparkSession) -> Versions:
        return Versions(spark, self.root)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The index, the chunk documents or the registry as of the last version."""
        versions = self.versions(spark)
        manifest = versions.manifest()
        return versions.read(name, replace(manifest, tables=self.tables() | manifest.tables))


def _in_order(documents: DataFrame) -> DataFrame:
    """Chunk documents with the fields of a chunk in the order of the schema."""
    fields = schemas.CHUNK_DOCUMENT["chunks"].dataType.elementType.fields

    def chunk(c: Column) -> Column:
        return F.struct(*[c[f.name].cast(f.dataType).alias(f.name) for f in fields])

    return documents.withColumn("chunks", F.transform("chunks", chunk))


def embed_new(chunks: DataFrame, known: DataFrame, encoder: Encoder) -> DataFrame:
    """Chunks with ``text_digest`` and ``embedding``.

    ``known`` has vectors by text digest.  Only texts without one reach the encoder, each
    distinct text once.
    """
    digested = materialize(
        chunks.withColumn("text_digest", content_digest(F.col("chunk_text"))), "digested"
    )
    vectors = known.groupBy("text_digest").agg(F.first("embedding").alias("embedding"))
    texts = digested.groupBy("text_digest").agg(F.first("chunk_text").alias("chunk_text"))
    fresh = (
        texts.join(vectors, "text_digest", "left_anti")
        .withColumn("embedding", encoder(F.col("chunk_text")))
        .drop("chunk_text")
    )
    every = vectors.join(digested.select("text_digest").distinct(), "text_digest", "left_semi")
    return digested.join(
        materialize(every.unionByName(fresh), "vectors"), "text_digest", "left"
    )


def _latest(embedded: DataFrame) -> DataFrame:
    """One row per label: that of its last chunk."""
    row = F.struct(*[f.name for f in INDEX_SCHEMA.fields if f.name != "chunk_uid"])
    latest = embedded.groupBy("chunk_uid").agg(F.max_by(row, "chunk_id").alias("_row"))
    return latest.select("chunk_uid", "_row.*")


def ingest_run(
    extracted: DataFrame,
    library: Library,
    run_id: str,
    encoder: Encoder = hash_embedding,
    recreate: bool = False,
    digests: DataFrame | None = None,
    gone: DataFrame | None = None,
) -> tuple[Manifest, DataFrame]:
    """Take in all readable documents as one version; that version, and the failures.

    Documents that are there already are replaced, stale chunks included; those of ``gone``
    (document_id, source_pdf) and those that only an earlier attempt of this run took in
    are removed.  ``digests`` has a content digest per source_pdf for the registry.
    ``recreate`` starts from empty tables.
    """
    spark = extracted.sparkSession
    versions = library.versions(spark)
    base = versions.manifest()
    start = Manifest(base.version) if recreate else base
    start = replace(start, tables=library.tables() | start.tables)
    folder = f"runs/{run_id}/{base.version}"

    extracted = materialize(extracted, "extracted")
    failed = F.col("error").isNotNull()
    pages = extracted.where(~failed).drop("error")
    chunks = materialize(rag.ingest(pages), "chunks")
    headers = rag.registry_rows(pages, chunks).withColumn("run_id", F.lit(run_id))
    if digests is None:
        headers = headers.withColumn("content_digest", F.lit(None).cast("string"))
    else:
        headers = headers.join(digests.select("source_pdf", "content_digest"), "source_pdf", "left")
    headers = materialize(schemas.conform(headers, REGISTRY_SCHEMA, strict=True), "headers")

    earlier = versions.read(REGISTRY, start).where(F.col("run_id") == run_id).select(*_FILE)
    removed = earlier.join(headers, _FILE, "left_anti")
    if gone is not None:
        removed = removed.unionByName(gone.select(*_FILE))
    touched = materialize(headers.select(*_FILE).unionByName(removed).distinct(), "touched")

    stale = versions.matching(CHUNK_JSON, touched, start).select(
        F.explode("chunks.chunk_uid").alias("chunk_uid")
    )
    stale = materialize(stale, "stale")
    before = versions.matching(INDEX, stale, start).select("text_digest", "embedding")

    documents = _in_order(chunk_documents_json(chunks, headers))
    incoming = {
        CHUNK_JSON: (documents, touched),
        INDEX: (_latest(embed_new(chunks, before, encoder)), stale),
        REGISTRY: (headers, touched),
    }
    tables = dict(start.tables)
    for name, (rows, dropped) in incoming.items():
        tables[name] = versions.replaced(tables[name], f"{folder}/{name}", rows, dropped)
    facts = {
        "finished_at": datetime.now(timezone.utc).isoformat(),
        "documents": headers.count(),
        "chunks": chunks.count(),
    }
    done = versions.commit(replace(start, tables=tables, runs=start.runs | {run_id: facts}))
    return done, extracted.where(failed)


def sync(
    files: DataFrame,
    library: Library,
    run_id: str,
    extractor: PageExtractor,
    method: str,
    encoder: Encoder = hash_embedding,
) -> tuple[DataFrame, DataFrame]:
    """Bring a library up to a listing of all files (path, content): new and changed ones
    are taken in, those no longer listed removed, the others not even read for text.

    Returns the change of each file (source_pdf, content_digest, status) and the files that
    could not be read.  Of a changed file that cannot be read the old content stays, and
    the next run tries it again.
    """
    spark = files.sparkSession
    listing = materialize(
        files.select(
            file_name(F.col("path")).alias("source_pdf"),
            content_digest(F.col("content")).alias("content_digest"),
        ),
        "listing",
    )
    registry = library.read(spark, REGISTRY)
    found = materialize(changes(listing, registry, "source_pdf", "content_digest"), "changes")
    wanted = found.where(F.col("status").isin(NEW, CHANGED)).select("source_pdf")
    taken = files.withColumn("source_pdf", file_name(F.col("path"))).join(
        wanted, "source_pdf", "left_semi"
    )
    gone = registry.join(found.where(F.col("status") == GONE), "source_pdf", "left_semi")
    _, failures = ingest_run(
        extract_pages(taken.drop("source_pdf"), extractor, method),
        library,
        run_id,
        encoder,
        digests=listing,
        gone=gone,
    )
    return found, failures


def reindex(
    spark: SparkSession, library: Library, run_id: str, encoder: Encoder = hash_embedding
) -> Manifest:
    """Build the index anew from the chunk documents, as one version, every text encoded."""
    versions = library.versions(spark)
    base = versions.manifest()
    start = replace(base, tables=library.tables() | base.tables)
    documents = versions.read(CHUNK_JSON, start)
    chunks = chunks_of_documents(documents, "source_pdf").withColumnRenamed(
        "source_pdf", "file_name"
    )
    none = versions.read_files(library.tables()[INDEX], [])
    rows = _latest(embed_new(chunks, none, encoder))
    folder = f"runs/{run_id}/{base.version}/{INDEX}"
    index = versions.replaced(library.tables()[INDEX], folder, rows)
    facts = {"finished_at": datetime.now(timezone.utc).isoformat()}
    return versions.commit(
        replace(start, tables=start.tables | {INDEX: index}, runs=start.runs | {run_id: facts})
    )
