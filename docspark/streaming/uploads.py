"""Upload events as a stream: decode, process, store, publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark import schemas
from docspark.functions import paths
from docspark.operators import tables
from docspark.operators.payload import payload_json
from docspark.plans.process import DocumentTables, documents, process
from docspark.sources import files as raw_files
from docspark.sources import landed, messages, objects, store
from docspark.sources.partitions import ARRIVED
from docspark.streaming.outbox import Outbox, Publisher


@dataclass(frozen=True)
class UploadJob:
    """What a micro-batch of upload messages is turned into.

    ``from_landing`` looks the paths of events up in the index of the landing job, of
    which a batch reads its own partitions. ``files`` gives path and length of raw
    files from elsewhere; a scan of a folder lists every file in it for every batch.
    Without either, paths are taken on trust.
    """

    store: store.Store
    tables: Callable[[], DocumentTables]
    backend: str | None = "tesseract"
    files: Callable[[], DataFrame] | None = None
    from_landing: bool = False
    publish: Publisher | None = None
    publish_required: bool = False

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Writes processed rows, dead letters and manifests of one batch.

        Every table gets the batch as one partition that a replay replaces.
        What follows the processed table reads it back, so the work is done
        once.
        """
        spark = batch.sparkSession
        decoded = self._checked(messages.decode_uploads(batch.select("value", "seq"))).persist()
        try:
            self._write(decoded, batch_id)
        finally:
            decoded.unpersist()

        done = store.processed_versions(spark, self.store, batch_id)
        location = F.lit(f"{self.store.processed}/{store.BATCH}={batch_id}#")
        uri = F.concat(location, F.col("doc_id"))
        uploads = done.withColumn("doc_type", F.col("upload_type"))
        manifest = tables.processed_manifest(uploads, uri, F.current_timestamp())
        store.write_manifest(manifest, self.store, "uploads", batch_id)

        if self.publish is not None:
            out = done.withColumn("json_uri", uri)
            box = Outbox(f"{self.store.outbox}/processed", self.publish)
            box.put(messages.to_messages(out, "doc_id", payload_json("json_uri")), batch_id)
            box.flush(spark, self.publish_required)

    def _checked(self, decoded: DataFrame) -> DataFrame:
        """Events whose file is missing get a reason, too.

        Bad messages have no path and stay out of the join, where their nulls
        would all meet in one task.
        """
        valid = messages.valid(decoded)
        if self.from_landing:
            known = landed.lookup(valid, self.store)
        elif self.files is not None:
            known = self.files()
        else:
            return decoded
        checked = raw_files.with_files(valid, known).drop("length")
        return checked.unionByName(messages.dead_letters(decoded), allowMissingColumns=True)

    def _write(self, decoded: DataFrame, batch_id: int) -> None:
        spark = decoded.sparkSession
        events = messages.valid(decoded)
        docs = documents(self.tables().restricted(events))
        rows = process(events.drop(ARRIVED), docs, self.backend)
        store.write_processed(rows, self.store, batch_id)

        columns = ["value", "seq", "doc_id", "file_path", "reason"]
        unread = store.unprocessed(spark, self.store, batch_id).select(columns)
        letters = messages.dead_letters(decoded).select(columns).unionByName(unread)
        store.write_batch(letters, self.store.dead_letters, batch_id)


def start(
    source: DataFrame, job: UploadJob, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the job on a stream of (value, seq).

    ``trigger`` are the arguments of ``DataStreamWriter.trigger``, by default
    the backlog in one go.
    """
    return (
        source.writeStream.foreachBatch(job.run_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@dataclass(frozen=True)
class LandingJob:
    """Takes in new files: one stored object each, index, queued manifest, upload message."""

    store: store.Store
    hint: str = "unknown"
    publish: Publisher | None = None

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Stores the files of a batch and registers them under the names they are stored by.

        The message names the stored object, so the inbox may be emptied. Ids and names
        follow from the files, so a batch that is run again replaces what it wrote.
        """
        spark = batch.sparkSession
        taken = raw_files.landed_uploads(batch, self.hint)
        objects.write_objects(taken.select(F.col("stored_name").alias("name"), "content"), self.store.objects)

        uri = F.concat(F.lit(f"{self.store.objects}/"), F.col("stored_name"))
        rows = taken.withColumns(
            {"source_path": F.col("path"), "file_path": uri, "storage": paths.storage_kind(uri)}
        )
        columns = ["doc_id", "file_path", "doc_type", "stored_name", "storage", "length"]
        columns += ["modificationTime", "source_path"]
        location = store.write_batch(rows.select(columns), self.store.raw, batch_id)
        uploads = spark.read.parquet(location)
        landed.merge(uploads, self.store)
        # The file's own time: a batch that is run again writes the same rows.
        manifest = tables.queued_manifest(uploads, F.col("modificationTime"))
        store.write_manifest(manifest, self.store, "landing", batch_id)
        if self.publish is not None:
            value = messages.event_json(uploads, schemas.UPLOAD_EVENT)
            box = Outbox(f"{self.store.outbox}/uploads", self.publish)
            box.put(messages.to_messages(uploads, "doc_id", value), batch_id)
            box.flush(spark, required=True)


def start_landing(
    source: DataFrame, job: LandingJob, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(job.run_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
