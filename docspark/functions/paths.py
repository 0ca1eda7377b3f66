"""Expressions over upload paths and URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
DEFAULT_SUFFIX = ".png"
DEFAULT_EXTENSION = ".bin"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".webp")
# ---------------------------------------------------------------------------


def _last_segment(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Extension of the last path segment with its dot, null if it has none.

    A dot that opens or ends the name does not start an extension.
    """
    return F.regexp_substr(_last_segment(path), F.lit(r"(?<=.)\.[^.]+$"))


def suffix(path: Column) -> Column:
    """Lower-cased extension before any ``?``, by default ``.png``."""
    before_query = F.substring_index(path, "?", 1)
    return F.coalesce(F.lower(extension(before_query)), F.lit(DEFAULT_SUFFIX))


def stored_name(doc_id: Column, original_name: Column) -> Column:
    """``doc_id`` plus the original extension, by default ``.bin``."""
    return F.concat(doc_id, F.coalesce(extension(original_name), F.lit(DEFAULT_EXTENSION)))


def storage_kind(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit("s3://")), F.lit("s3")).otherwise(F.lit("local"))


def _without_scheme(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit("s3://")), F.substring(uri, 6, 1 << 30)).otherwise(uri)


def bucket(uri: Column) -> Column:
    """Part before the first ``/`` of an object URI."""
    return F.substring_index(_without_scheme(uri), "/", 1)


def key(uri: Column) -> Column:
    """Part after the first ``/`` of an object URI, empty if there is none."""
    return F.regexp_extract(_without_scheme(uri), r"(?s)^[^/]*/(.*)$", 1)


def ocr_route(uri: Column, backend: str) -> Column:
    """Which reader a document goes to, by backend, suffix and storage."""
    is_pdf = suffix(uri) == ".pdf"
    if backend != "textract":
        return F.when(is_pdf, F.lit("pdf_render")).otherwise(F.lit("image"))
    return (
        F.when(is_pdf, F.lit("pdf_render"))
        .when(F.startswith(uri, F.lit("s3://")), F.lit("textract_async"))
        .otherwise(F.lit("textract_sync"))
    )


def path_key(uri: Column) -> Column:
    """Path form under which events and scanned files meet.

    ``file:///a``, ``file:/a`` and ``/a`` name one file, as do ``s3://`` and
    the ``s3a://`` a scan reports.
    """
    local = F.regexp_replace(uri, "^file:/+", "/")
    return F.regexp_replace(local, "^s3[an]://", "s3://")
