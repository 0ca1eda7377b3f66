"""Feedback events as a stream: append to the log, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark import schemas
from docspark.sources import messages, store
from docspark.streaming.outbox import Outbox, Publisher


def decode(batch: DataFrame) -> DataFrame:
    """Feedback events of (value, seq), with a ``reason`` where a value is no JSON object.

    Empty messages are skipped, as in the upload topic.
    """
    rows = batch.select(F.col("value").cast("string").alias("value"), "seq").filter(
        F.coalesce("value", F.lit("")) != ""
    )
    parsed = rows.withColumn("_row", messages.json_object(F.col("value"), schemas.FEEDBACK))
    reason = F.when(F.col("_row").isNull(), messages.INVALID_JSON)
    return parsed.select("value", "seq", "_row.*", reason.alias("reason"))


@dataclass(frozen=True)
class FeedbackJob:
    store: store.Store
    publish: Publisher | None = None

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Writes the events and, apart from them, what could not be read.

        The source is read once. An event without an id gets one from its place in
        the topic and its text, so a batch that is run again writes the same rows.
        """
        spark = batch.sparkSession
        decoded = decode(batch).persist()
        try:
            letters = messages.dead_letters(decoded).select("value", "seq", "reason")
            store.write_batch(letters, self.store.feedback_dead_letters, batch_id)
            own_id = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "value"), 256)
            events = store.with_ids(messages.valid(decoded), own_id).select(*schemas.FEEDBACK.names)
            location = store.write_batch(events, self.store.feedback, batch_id)
        finally:
            decoded.unpersist()
        if self.publish is not None:
            events = spark.read.schema(schemas.FEEDBACK).parquet(location)
            value = messages.event_json(events, schemas.FEEDBACK)
            box = Outbox(f"{self.store.outbox}/feedback", self.publish)
            box.put(messages.to_messages(events, "doc_id", value), batch_id)
            box.flush(spark)


def start(
    source: DataFrame, job: FeedbackJob, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(job.run_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
