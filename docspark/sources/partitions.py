"""Tables cut into partitions by a hash or a date, of which a batch reads only those it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from docspark.functions import paths

BUCKET = "path_bucket"
MAX_BUCKETS = 1 << 16
ARRIVED = "arrived"
BATCH = "batch_id"
_LAST_DAY = "9999-12-31"
# Characters of a part of texts: about three million words.
PART_CHARACTERS = 16 << 20


def path_bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(paths.path_key(path)), F.lit(buckets)).cast("int")


def only(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of the partitions of ``table`` that ``keys`` names in its column of that name.

    ``column`` is a bucket number or a date, so the distinct values are few whatever
    the keys are: they are broadcast, and the scan lists and opens only their partitions.
    """
    day = isinstance(keys.schema[column].dataType, DateType)
    # The comparison holds for all values; it tells the optimizer that the join selects.
    known = F.col(column) <= F.lit(_LAST_DAY).cast("date") if day else F.col(column) < MAX_BUCKETS
    return table.join(F.broadcast(keys.select(column).filter(known).distinct()), column, "left_semi")


def overwrite_partitions(rows: DataFrame, location: str, *columns: str) -> None:
    """Writes rows into the partitions they belong to, each replaced as a whole; others stay as they are."""
    dealt = rows.repartition(*columns)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*columns).parquet(location)


def text_parts(texts: DataFrame) -> int:
    """Parts for rows with a ``text``, of which each can be made into rows of words and sorted by a task."""
    characters = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), characters // PART_CHARACTERS + 1)


def dealt_texts(docs: DataFrame, *keys: Column | str, parts: int | None = None) -> DataFrame:
    """Rows with a ``text``, dealt by some keys into parts that tasks can make into rows of words and sort.

    The words of a part of a file may be many times its bytes, and are then spilled.
    """
    return docs.repartition(parts or text_parts(docs), *keys)


def dealt_arrivals(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents that carry the day they ``arrived``, dealt by day and document before they are made into words."""
    return dealt_texts(docs, ARRIVED, F.pmod(F.xxhash64("doc_id"), F.lit(64)), parts=parts)


def write_arrivals(rows: DataFrame, location: str, batch_id: int, dealt: bool = False) -> None:
    """Writes rows that carry the day their document ``arrived`` as one batch of a document table.

    A day is one folder per batch: a batch that is run again replaces its own rows, and
    a reader that knows the day of a document opens only that day. Large days of a
    batch are not gathered into one task: rows are dealt by day and document, unless
    they were made of rows ``dealt`` so.
    """
    dated = rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    if not dealt:
        dated = dated.repartition(ARRIVED, F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(ARRIVED, BATCH).parquet(location)
