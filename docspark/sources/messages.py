"""Decoding of JSON messages and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark import schemas
from docspark.functions import pyjson
from docspark.functions.text import once

INVALID_JSON = "invalid_json_object"
MISSING_DOC_ID = "missing_doc_id"
MISSING_FILE_PATH = "missing_file_path"
FILE_NOT_FOUND = "file_not_found"
MISSING_FIELD = "missing_field"


def json_object(value: Column, schema: StructType) -> Column:
    """The one JSON object a text holds, null for any other text.

    The text is read as the only item of an array. So text after the object,
    a bare array or a bare scalar is an error, which it is not when the text is
    read as an object: there the parser stops at the closing brace.
    """
    wrapped = F.concat(F.lit("["), value, F.lit("]"))
    parsed = F.from_json(
        wrapped, f"array<{schema.simpleString()}>", {"allowSingleQuotes": "false"}
    )
    return once(parsed, lambda items: F.when(F.size(items) == 1, F.get(items, 0)))


def decode_uploads(messages: DataFrame, value: str = "value") -> DataFrame:
    """Upload events of messages with a ``reason`` where one is unusable.

    Empty messages are skipped. A bad message marks its own row only. Columns
    of the input other than the value are kept, the value too.
    """
    decoded = messages.withColumn(value, F.col(value).cast("string")).filter(
        F.coalesce(F.col(value), F.lit("")) != ""
    )
    decoded = decoded.withColumn("_event", json_object(F.col(value), schemas.UPLOAD_EVENT))
    reason = (
        F.when(F.col("_event").isNull(), INVALID_JSON)
        .when(F.col("_event.doc_id").isNull(), MISSING_DOC_ID)
        .when(F.col("_event.file_path").isNull(), MISSING_FILE_PATH)
    )
    return decoded.select(
        *messages.columns,
        "_event.doc_id",
        "_event.file_path",
        F.coalesce(F.nullif("_event.doc_type", F.lit("")), F.lit("unknown")).alias("doc_type"),
        reason.alias("reason"),
    )


def valid(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull()).drop("reason")


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull())


def upload_hint(doc_type: Column) -> Column:
    """'unknown' is no hint."""
    return F.nullif(doc_type, F.lit("unknown"))


def to_messages(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Key and value of messages to publish."""
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value"))


def event_json(df: DataFrame, schema: StructType) -> Column:
    """JSON text of the schema's columns, nulls printed."""
    return pyjson.dumps(F.struct(*(df[name] for name in schema.names)), schema)
