"""Files of one JSON object each as a table: every file is read once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docspark.operators import keyed
from docspark.sources import messages, store
from docspark.sources.files import many_files

FILE = "file"
_SOURCE = {"wholetext": "true", "recursiveFileLookup": "true"}


def stream_objects(spark: SparkSession, directory: str, glob: str = "*.json", **options: str) -> DataFrame:
    """New files of a directory and the folders in it: value, file and time.

    Which files were read is kept in the checkpoint of the query. A file that is
    written again under its name is not read again; the writer gives it a new name.
    """
    reader = many_files(spark).readStream.format("text").options(**_SOURCE, pathGlobFilter=glob, **options)
    return reader.load(directory).select(
        "value",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_modification_time").alias("modificationTime"),
    )


@dataclass(frozen=True)
class ObjectTableJob:
    """Appends the objects of new files to a table, and what is none to dead letters.

    An object must have a ``doc_id``. Both tables name the file of every row.
    """

    table: str
    dead_letters: str
    schema: StructType

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Both tables get the batch as one partition that a replay replaces; files are read once."""
        text = F.when(F.is_valid_utf8("value"), F.col("value"))
        rows = batch.withColumn("_row", messages.json_object(text, self.schema))
        no_id = F.coalesce("_row.doc_id", F.lit("")) == ""
        reason = F.when(F.col("_row").isNull(), messages.INVALID_JSON).when(no_id, messages.MISSING_DOC_ID)
        read = rows.withColumn("reason", reason).persist()
        try:
            objects = read.filter("reason IS NULL").select("_row.*", FILE, "modificationTime")
            store.write_batch(objects, self.table, batch_id)
            letters = read.filter("reason IS NOT NULL").select(FILE, "modificationTime", "value", "reason")
            store.write_batch(letters, self.dead_letters, batch_id)
        finally:
            read.unpersist()

    def latest(self, spark: SparkSession, key: str = "doc_id") -> DataFrame:
        """The last object of every key, by the time of its file."""
        rows = spark.read.parquet(self.table)
        newest = [F.col(c).desc() for c in ("modificationTime", store.BATCH, FILE)]
        return keyed.latest_rows(rows, [key], newest)


def start(source: DataFrame, job: ObjectTableJob, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(job.run_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
