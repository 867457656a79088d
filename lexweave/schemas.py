"""One registry of table schemas; DDL and typed projections come from it.

Dates and times are DATE and TIMESTAMP, vectors ``array<float>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_STRING, _INT, _LONG = StringType(), IntegerType(), LongType()
_DATE, _TIME = DateType(), TimestampType()


def _columns(**types: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in types.items()])


def _joined(*parts: StructType) -> StructType:
    return StructType([field for part in parts for field in part.fields])


_CHUNK = _columns(
    chunk_uid=_STRING,
    document_id=_STRING,
    file_name=_STRING,
    chunk_id=_INT,
    page_number=_INT,
    chunk_type=_STRING,
    article_number=_STRING,
    annex_number=_STRING,
    title=_STRING,
    part_index=_INT,
    part_count=_INT,
    chunk_text=_STRING,
    char_length=_INT,
    law_passed_date=_DATE,
    ingested_at=_TIME,
)
_SOURCE = _columns(source_path=_STRING, source_name=_STRING, regulation_family=_STRING)

PAGES = _columns(
    document_id=_STRING,
    file_name=_STRING,
    page_number=_INT,
    page_text=_STRING,
    char_count=_INT,
    extraction_method=_STRING,
)

TABLES: dict[str, StructType] = {
    "bronze_raw_documents": _columns(
        document_id=_STRING,
        file_name=_STRING,
        source_path=_STRING,
        source_name=_STRING,
        regulation_family=_STRING,
        file_type=_STRING,
        ingestion_timestamp=_TIME,
        status=_STRING,
    ),
    "silver_extracted_pages": _joined(PAGES, _columns(extracted_at=_TIME)),
    "silver_chunks": _joined(_CHUNK, _columns(created_at=_TIME)),
    "gold_ai_ready_chunks": _joined(_CHUNK, _SOURCE, _columns(gold_created_at=_TIME)),
    "gold_embedded_chunks": _joined(
        _CHUNK,
        _SOURCE,
        _columns(
            embedding=ArrayType(FloatType()),
            embedding_model=_STRING,
            embedding_version=_STRING,
            embedded_at=_TIME,
        ),
    ),
    "pipeline_run_log": _columns(
        step_name=_STRING, status=_STRING, row_count=_LONG, message=_STRING, logged_at=_TIME
    ),
}

_DOCUMENT_META = _columns(
    document_id=_STRING,
    source_pdf=_STRING,
    regulation_title=_STRING,
    document_version=_STRING,
    issuing_authority=_STRING,
    law_passed_date=_DATE,
    ingested_at=_TIME,
)

CHUNK_DOCUMENT = _joined(
    _DOCUMENT_META,
    _columns(
        chunk_count=_INT,
        piece=_INT,
        chunks=ArrayType(
            _columns(
                chunk_uid=_STRING,
                chunk_id=_INT,
                type=_STRING,
                article_number=_STRING,
                annex_number=_STRING,
                title=_STRING,
                part_index=_INT,
                part_count=_INT,
                page=_INT,
                text=_STRING,
                char_length=_INT,
            )
        ),
    ),
)

REGISTRY = _joined(_DOCUMENT_META, _columns(chunk_count=_LONG))

GOLDEN = _columns(act=_STRING, question=_STRING, ground_truth=_STRING)

EVAL_COLUMNS = (
    "act",
    "question",
    "ground_truth",
    "answer",
    "faithfulness",
    "response_relevancy",
    "context_precision",
)


def conform(df: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """Select the schema's columns in order; absent ones are null.

    A value that does not fit its type becomes null, or ends the job where ``strict``.
    """

    def column(field) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        fitting = value.try_cast(field.dataType)
        if strict and df.schema[field.name].dataType != field.dataType:
            message = F.concat(
                F.lit(f"{field.name} is no {field.dataType.simpleString()}: "),
                value.cast("string"),
            )
            fitting = F.when(
                value.isNotNull() & fitting.isNull(),
                F.raise_error(message).cast(field.dataType),
            ).otherwise(fitting)
        return fitting.alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


def create_table_ddl(qualified: str, schema: StructType, fmt: str) -> str:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {qualified} ({columns}) USING {fmt}"
