"""The files that landing has taken in, as a table keyed by path.

Partitions are hashes of the path. A landing batch reads and rewrites only the
partitions of its own files, and a batch of upload events reads only those of
its events: neither grows with the number of batches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from docspark.functions import paths
from docspark.operators import keyed
from docspark.sources import filesystem
from docspark.sources.partitions import ARRIVED, BUCKET, only, overwrite_partitions, path_bucket
from docspark.sources.store import Store

_ROWS = StructType(
    [
        StructField("path", StringType()),
        StructField("doc_id", StringType()),
        StructField("length", LongType()),
        StructField("modificationTime", TimestampType()),
        StructField(ARRIVED, DateType()),
        StructField(BUCKET, IntegerType()),
    ]
)


def _marker(store: Store) -> str:
    return f"{store.landed}_merging"


def index_rows(landed: DataFrame, buckets: int) -> DataFrame:
    """Index rows of landed files (file_path, doc_id, length, modificationTime)."""
    return landed.select(
        F.col("file_path").alias("path"),
        "doc_id",
        "length",
        "modificationTime",
        F.to_date("modificationTime").alias(ARRIVED),
        path_bucket(F.col("file_path"), buckets).alias(BUCKET),
    )


def _newest(rows: DataFrame) -> DataFrame:
    """One row per path: of a path landed more than once, the latest file."""
    newest = [F.col(c).desc_nulls_last() for c in ("modificationTime", "length", "doc_id")]
    return keyed.latest_rows(rows.withColumn("_key", paths.path_key(F.col("path"))), ["_key"], newest).drop("_key")


def index(spark: SparkSession, store: Store) -> DataFrame:
    """Every landed path once: path, doc_id, length, modificationTime, arrived and its partition.

    Empty before the first file has landed.
    """
    if not filesystem.exists(spark, store.landed):
        return spark.createDataFrame([], _ROWS)
    return spark.read.schema(_ROWS).parquet(store.landed)


def merge(landed: DataFrame, store: Store) -> None:
    """Brings a batch of landed files into the index; running it again changes nothing.

    Partitions are replaced one after the other when the write is committed. A merge
    that was cut off there has left its marker, and the next one starts from the
    landing log.
    """
    spark = landed.sparkSession
    if filesystem.exists(spark, _marker(store)):
        rebuild(spark, store)
    rows = index_rows(landed, store.buckets).persist()
    try:
        known = only(index(spark, store), BUCKET, rows).unionByName(rows)
        filesystem.create_if_absent(spark, _marker(store), "")
        overwrite_partitions(_newest(known), store.landed, BUCKET)
        filesystem.delete(spark, _marker(store))
    finally:
        rows.unpersist()


def rebuild(spark: SparkSession, store: Store) -> None:
    """Makes the index anew from the log of the landing job."""
    log = spark.read.parquet(store.raw)
    overwrite_partitions(_newest(index_rows(log, store.buckets)), store.landed, BUCKET)
    filesystem.delete(spark, _marker(store))


def lookup(events: DataFrame, store: Store) -> DataFrame:
    """Index rows that upload events may refer to: those of the partitions of their paths."""
    wanted = events.select(path_bucket(F.col("file_path"), store.buckets).alias(BUCKET))
    return only(index(events.sparkSession, store), BUCKET, wanted)
