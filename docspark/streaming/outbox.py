"""Messages that are sent once: kept until all are out, part by part."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources import filesystem

log = logging.getLogger(__name__)

Publisher = Callable[[DataFrame, str], None]
_WRITTEN = "_SUCCESS"


@dataclass(frozen=True)
class Outbox:
    """Messages (key, value) of micro-batches on their way to one topic.

    A batch is written down before it is sent, in parts by key. A part that was sent
    gets a marker. A batch that runs again finds what it has written and sends only
    parts without a marker, so that a break costs at most one part sent twice, and
    none with a publisher that replaces a part under its name. What could not be
    sent goes out before the next batch.
    """

    base: str
    publish: Publisher
    parts: int = 8

    def _messages(self, batch_id: int) -> str:
        return f"{self.base}/messages/batch_id={batch_id}"

    def _sent(self, batch_id: int) -> str:
        return f"{self.base}/sent/batch_id={batch_id}"

    def _done(self, batch_id: int) -> str:
        return f"{self.base}/done/batch_id={batch_id}"

    def put(self, messages: DataFrame, batch_id: int) -> None:
        """Keeps the messages of a batch, unless it has done so before."""
        spark, location = messages.sparkSession, self._messages(batch_id)
        if filesystem.exists(spark, self._done(batch_id)) or filesystem.exists(spark, f"{location}/{_WRITTEN}"):
            return
        # Messages of a key stay together and in order.
        part = F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")
        kept = messages.select("key", "value", part.alias("part"))
        kept.write.mode("overwrite").partitionBy("part").parquet(location)

    def pending(self, spark: SparkSession) -> list[int]:
        """Batches that are not out yet, oldest first."""
        found = filesystem.names(spark, f"{self.base}/messages")
        batches = sorted(int(name.split("=")[1]) for name in found if name.startswith("batch_id="))
        return [b for b in batches if filesystem.exists(spark, f"{self._messages(b)}/{_WRITTEN}")]

    def flush(self, spark: SparkSession, required: bool = False) -> bool:
        """Sends what is pending. A failure is raised if sending is required, else logged: false."""
        for batch_id in self.pending(spark):
            try:
                self._send(spark, batch_id)
            except Exception:
                if required:
                    raise
                log.exception("batch %s was not published", batch_id)
                return False
        return True

    def _send(self, spark: SparkSession, batch_id: int) -> None:
        location, sent = self._messages(batch_id), set(filesystem.names(spark, self._sent(batch_id)))
        for part in filesystem.names(spark, location):
            if part.startswith("part=") and part not in sent:
                rows = spark.read.schema("key STRING, value STRING").parquet(f"{location}/{part}")
                self.publish(rows, f"{batch_id}-{part.split('=')[1]}")
                filesystem.create_if_absent(spark, f"{self._sent(batch_id)}/{part}", "")
        filesystem.create_if_absent(spark, self._done(batch_id), "")
        filesystem.delete(spark, location)
        filesystem.delete(spark, self._sent(batch_id))
