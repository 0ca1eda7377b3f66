"""Raw document files: scan, landing of new uploads, join with events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import paths
from docspark.functions import patterns as P
from docspark.sources.messages import FILE_NOT_FOUND
from docspark.sources.partitions import ARRIVED

_BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# By default a file counts as 4 MB at least, 32 to a task, and a batch of new files is looked up by
# 10,000 tasks. With many small files the tasks then cost more than the files.
_MANY_FILES = {
    "spark.sql.files.openCostInBytes": "64k",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}


# Texts of a task that makes them into rows of words; by default a task reads 128 MB.
_SHORT_PARTS = {"spark.sql.files.maxPartitionBytes": "16m"}


def many_files(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` for reading many small files; what ``spark`` sets itself stays.

    A scan, and a stream for its batches, keeps to the settings of the session it was read by.
    """
    return _session_like(spark, _MANY_FILES)


def short_parts(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` for reading rows that grow to many times their bytes; what ``spark`` sets itself stays."""
    return _session_like(spark, _SHORT_PARTS)


def _session_like(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    session = spark.newSession()
    for name, value in {**settings, **spark.conf.getAll}.items():
        if session.conf.get(name, None) != value:
            session.conf.set(name, value)
    return session


def read_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Every file under a directory: path, modificationTime, length, content.

    Content is read only by plans that select it.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(directory)
    )


def stream_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """New files of a landing directory as a stream."""
    return (
        many_files(spark)
        .readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(directory)
    )


def landed_uploads(files: DataFrame, hint: str = P.UNKNOWN) -> DataFrame:
    """Upload records of non-empty files.

    The id is a digest of path and modification time: a replayed batch gives
    the same ids and a file uploaded again gets a new one.
    """
    uploads = files.filter(F.col("length") > 0)
    doc_id = F.sha2(
        F.concat_ws("|", "path", F.unix_micros("modificationTime").cast("string")), 256
    )
    return uploads.withColumn("doc_id", doc_id).withColumns(
        {
            "file_path": F.col("path"),
            "doc_type": F.lit(hint),
            "stored_name": paths.stored_name(F.col("doc_id"), F.col("path")),
            "storage": paths.storage_kind(F.col("path")),
        }
    )


def with_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events with their file's ``length``; ``reason`` set where it is missing.

    One scan of the file table by path, not one fetch per event. Of a path that
    was landed more than once the latest file counts, or the longest where the
    table has no ``modificationTime``; the events stay as many as they are. The day
    the file ``arrived`` comes along where the table has it.
    """
    order = "modificationTime" if "modificationTime" in files.columns else "length"
    given = ["length"] + [ARRIVED for _ in range(ARRIVED in files.columns)]
    found = files.groupBy(paths.path_key(F.col("path")).alias("_path")).agg(
        *(F.max_by(name, order).alias(name) for name in given)
    )
    joined = events.withColumn("_path", paths.path_key(F.col("file_path"))).join(
        found, "_path", "left"
    )
    missing = F.when(F.col("length").isNull(), FILE_NOT_FOUND)
    return joined.withColumn("reason", missing).drop("_path")
