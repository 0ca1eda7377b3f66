"""Tables on shared storage: batch-partitioned sinks, scans and views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from docspark import schemas
from docspark.functions.times import utc_iso
from docspark.operators import keyed, tables
from docspark.operators.payload import payload_json
from docspark.sources.messages import json_object

BATCH = "batch_id"
SEQUENCE = "seq"
USABLE = "usable"


def _with(schema: StructType, *fields: StructField) -> StructType:
    return StructType([*schema.fields, *fields])


_BATCH = StructField(BATCH, LongType())
_PROCESSED_ROWS = _with(
    schemas.PROCESSED,
    StructField("file_path", StringType()),
    StructField("upload_type", StringType()),
    StructField("value", StringType()),
    StructField(SEQUENCE, LongType()),
    StructField("reason", StringType()),
    _BATCH,
    StructField(USABLE, BooleanType()),
)


@dataclass(frozen=True)
class Store:
    """Locations of the pipeline's tables under one base URI.

    ``buckets`` is the number of partitions of the landing index. It belongs to the
    table: a store with billions of files is made with thousands.
    """

    base: str
    buckets: int = 256

    @property
    def processed(self) -> str:
        return f"{self.base}/processed"

    @property
    def manifests(self) -> str:
        return f"{self.base}/ingest"

    @property
    def feedback(self) -> str:
        return f"{self.base}/feedback"

    @property
    def feedback_dead_letters(self) -> str:
        return f"{self.base}/feedback_dead_letters"

    @property
    def raw(self) -> str:
        return f"{self.base}/raw"

    @property
    def objects(self) -> str:
        return f"{self.base}/objects"

    @property
    def landed(self) -> str:
        return f"{self.base}/landed"

    @property
    def outbox(self) -> str:
        return f"{self.base}/outbox"

    @property
    def dead_letters(self) -> str:
        return f"{self.base}/dead_letters"

    @property
    def runs(self) -> str:
        return f"{self.base}/runs"

    @property
    def model_versions(self) -> str:
        return f"{self.base}/model_versions"


def write_batch(df: DataFrame, table: str, batch_id: int) -> str:
    """Writes a batch as one partition, replacing it if it is there.

    A batch that is run again leaves the table as it was.
    """
    location = f"{table}/{BATCH}={batch_id}"
    df.write.mode("overwrite").parquet(location)
    return location


def write_processed(rows: DataFrame, store: Store, batch_id: int) -> None:
    """Writes processed rows and, apart from them, rows that have a ``reason``."""
    usable = F.col("reason").isNull()
    split = rows.withColumns({USABLE: usable, "value": F.when(~usable, F.col("value"))})
    location = f"{store.processed}/{BATCH}={batch_id}"
    split.write.mode("overwrite").partitionBy(USABLE).parquet(location)


def _processed_rows(spark: SparkSession, store: Store, batch_id: int | None) -> DataFrame:
    """All processed rows, or those of one batch: only its folder is listed."""
    rows = spark.read.schema(_PROCESSED_ROWS).option("basePath", store.processed)
    one = "" if batch_id is None else f"/{BATCH}={batch_id}"
    return rows.parquet(store.processed + one)


def processed_versions(spark: SparkSession, store: Store, batch_id: int | None = None) -> DataFrame:
    """Every processed row written so far, or in one batch."""
    rows = _processed_rows(spark, store, batch_id)
    return rows.filter(USABLE).drop(USABLE, "reason", "value")


def unprocessed(spark: SparkSession, store: Store, batch_id: int | None = None) -> DataFrame:
    """Upload events that could not be processed."""
    return _processed_rows(spark, store, batch_id).filter(~F.col(USABLE))


def processed(spark: SparkSession, store: Store) -> DataFrame:
    """Last write of every document."""
    versions = processed_versions(spark, store)
    return tables.latest_processed(versions, [BATCH, SEQUENCE])


def manifests(spark: SparkSession, store: Store) -> DataFrame:
    schema = _with(schemas.MANIFEST, StructField("job", StringType()), _BATCH)
    log = spark.read.schema(schema).parquet(store.manifests)
    return tables.manifest_status(log.drop("job", BATCH))


def write_manifest(rows: DataFrame, store: Store, job: str, batch_id: int) -> None:
    """Manifest rows of one batch of a job; jobs count their batches apart."""
    write_batch(rows, f"{store.manifests}/job={job}", batch_id)


def compact_processed(spark: SparkSession, store: Store, target: Store, batch_id: int = 0) -> None:
    """Writes the latest view as one batch of another store.

    Superseded rows are left behind; the order column restarts.
    """
    latest = processed(spark, store).drop(BATCH)
    plain = F.lit(None).cast("string")
    write_processed(latest.withColumns({"reason": plain, "value": plain}), target, batch_id)


def append_feedback(events: DataFrame, store: Store) -> None:
    """Appends feedback events to the log; events without an id get one."""
    with_ids(events).write.mode("append").parquet(store.feedback)


def with_ids(events: DataFrame, new_id: Column | None = None) -> DataFrame:
    """Events of which each has an id: a null or empty one is replaced."""
    new_id = F.uuid() if new_id is None else new_id
    return events.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), new_id))


def recorded(corrections: DataFrame) -> DataFrame:
    """New feedback events of corrections (doc_id, field, predicted, actual)."""
    return corrections.select(
        F.uuid().alias("event_id"),
        "doc_id",
        "field",
        "predicted",
        "actual",
        utc_iso(F.current_timestamp()).alias("ts"),
    )


def feedback(spark: SparkSession, store: Store) -> DataFrame:
    """The log with one row per event: an event that came again replaces itself."""
    log = (
        spark.read.schema(schemas.FEEDBACK)
        .option("recursiveFileLookup", "true")
        .parquet(store.feedback)
    )
    return latest_feedback(log)


def latest_feedback(log: DataFrame) -> DataFrame:
    """Last write of every event id, by ``ts``; equal ones by their other columns."""
    others = [name for name in schemas.FEEDBACK.names if name not in ("event_id", "ts")]
    newest = [F.col(name).desc_nulls_last() for name in ("ts", *others)]
    return keyed.latest_rows(log, ["event_id"], newest)


def raw_files(spark: SparkSession, store: Store) -> DataFrame:
    """Path, length and time of the files the landing job has taken in.

    Only these columns are read, not the contents.
    """
    raw = spark.read.parquet(store.raw)
    return raw.select(F.col("file_path").alias("path"), "length", "modificationTime")


def write_processed_json(df: DataFrame, directory: str) -> None:
    """Writes processed rows as JSON, one object per line, in compressed files."""
    rows = df.select(payload_json().alias("value"))
    rows.write.mode("overwrite").option("compression", "gzip").text(directory)


def read_json_objects(
    spark: SparkSession,
    directory: str,
    schema: StructType,
    glob: str = "*.json",
    whole_files: bool = True,
) -> DataFrame:
    """Rows of JSON files that hold one object each, or one object per line.

    Text that is no JSON object, and objects without a doc_id, are skipped.
    """
    texts = spark.read.text(
        directory, wholetext=whole_files, recursiveFileLookup=True, pathGlobFilter=glob
    )
    objects = texts.filter(F.is_valid_utf8("value")).select(
        json_object(F.col("value"), schema).alias("_row")
    )
    return objects.select("_row.*").filter(F.coalesce("doc_id", F.lit("")) != "")


def read_processed_json(spark: SparkSession, directory: str, **options) -> DataFrame:
    return read_json_objects(spark, directory, schemas.PROCESSED, **options)


def read_feedback_json(spark: SparkSession, directory: str, **options) -> DataFrame:
    return read_json_objects(spark, directory, schemas.FEEDBACK, **options)
