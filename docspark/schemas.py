"""Record schemas of every table and message."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, data_type) for name, data_type in fields])


def _strings(*names: str) -> StructType:
    return _struct(*((name, StringType()) for name in names))


_TEXT, _INT, _DOUBLE = StringType(), IntegerType(), DoubleType()
_GEOMETRY = tuple((name, _INT) for name in ("left", "top", "width", "height"))

ENTITY = _struct(("text", _TEXT), ("type", _TEXT), ("score", _DOUBLE))
KEY_PHRASE = _struct(("text", _TEXT), ("score", _DOUBLE))
BBOX = _struct(*((name, _DOUBLE) for name in ("Left", "Top", "Width", "Height")))
WORD_BLOCK = _struct(("page", _INT), ("text", _TEXT), *_GEOMETRY, ("confidence", _DOUBLE))
LINE_BLOCK = _struct(
    ("type", _TEXT), ("text", _TEXT), ("confidence", _DOUBLE), ("page", _INT), ("bbox", BBOX)
)
# Words carry pixel geometry, lines a relative box; `type` is set for lines.
LAYOUT_BLOCK = _struct(
    ("type", _TEXT),
    ("text", _TEXT),
    ("confidence", _DOUBLE),
    ("page", _INT),
    ("bbox", BBOX),
    *_GEOMETRY,
)

UPLOAD_EVENT = _strings("doc_id", "file_path", "doc_type")
MANIFEST = _strings("doc_id", "file_path", "doc_type", "status", "ts", "processed_uri")
FEEDBACK = _strings("event_id", "doc_id", "field", "predicted", "actual", "ts")

FIELDS = _struct(
    ("name", _TEXT),
    ("email", _TEXT),
    ("phone", ArrayType(_TEXT)),
    ("skills", ArrayType(_TEXT)),
    ("invoice_number", _TEXT),
    ("total", _TEXT),
    ("vendor_email", _TEXT),
    ("date_of_birth", _TEXT),
    ("document_id", _TEXT),
    ("raw_preview", _TEXT),
    ("organization", _TEXT),
    ("ml_entities", ArrayType(ENTITY)),
)
PROCESSED = _struct(
    ("doc_id", _TEXT),
    ("doc_type", _TEXT),
    ("fields", FIELDS),
    ("confidence", _DOUBLE),
    ("ocr", _strings("backend")),
    ("ml", _struct(("entities", ArrayType(ENTITY)), ("key_phrases", ArrayType(KEY_PHRASE)))),
    ("layout", _struct(("line_count", LongType()), ("lines", ArrayType(LAYOUT_BLOCK)))),
)
MODEL_VERSION = _struct(
    ("name", _TEXT), ("version", _INT), ("stage", _TEXT), ("run_id", _TEXT), ("path", _TEXT)
)
RUN = _struct(
    ("run_id", _TEXT),
    ("model", _TEXT),
    ("samples", LongType()),
    ("accuracy", _DOUBLE),
    ("loss", _DOUBLE),
    ("path", _TEXT),
)

# --- fixed values ----------------------------------------------------------
TOPIC_UPLOADS = "document_uploads"
TOPIC_PROCESSED = "processed_documents"
TOPIC_FEEDBACK = "feedback_events"
