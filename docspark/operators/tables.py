"""Keyed tables of the pipeline: processed documents, manifests, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.times import utc_iso
from docspark.operators import keyed

# --- fixed values ----------------------------------------------------------
QUEUED = "queued"
PROCESSED = "processed"
# ---------------------------------------------------------------------------


def latest_processed(versions: DataFrame, arrival: list[str]) -> DataFrame:
    """Processed table as readers see it: the last write of every document."""
    return keyed.latest_rows(versions, ["doc_id"], [F.col(name).desc() for name in arrival])


def queued_manifest(uploads: DataFrame, at: Column) -> DataFrame:
    """Manifest rows of accepted uploads."""
    return uploads.select(
        "doc_id",
        "file_path",
        "doc_type",
        F.lit(QUEUED).alias("status"),
        utc_iso(at).alias("ts"),
        F.lit(None).cast("string").alias("processed_uri"),
    )


def processed_manifest(events: DataFrame, uri: Column, at: Column) -> DataFrame:
    """Manifest rows of processed uploads; they keep the hint as the type."""
    return events.select(
        "doc_id",
        "file_path",
        "doc_type",
        F.lit(PROCESSED).alias("status"),
        utc_iso(at).alias("ts"),
        uri.alias("processed_uri"),
    )


def manifest_status(log: DataFrame) -> DataFrame:
    """Current manifest of every upload: the last row of its furthest status.

    A landing batch that is run again writes its queued rows once more; an upload
    that has been processed stays processed.
    """
    newest_first = [(F.col("status") == PROCESSED).desc(), F.col("ts").desc()]
    return keyed.latest_rows(log, ["doc_id"], newest_first)


def status_of_uploads(uploads: DataFrame, processed: DataFrame) -> DataFrame:
    """Manifest status derived from the uploads and the processed table.

    ``processed`` has one row per document with its ``processed_uri``.
    """
    done = processed.select("doc_id", "processed_uri")
    return uploads.join(done, "doc_id", "left").withColumn(
        "status",
        F.when(F.col("processed_uri").isNotNull(), PROCESSED).otherwise(QUEUED),
    )
