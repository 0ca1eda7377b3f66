"""Message topics: Kafka in production, a directory of JSON text elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Values of a topic from the earliest offset on, with their arrival order.

    ``seq`` orders the values of one key: a key stays in one Kafka partition,
    where the offset counts up. Needs the Kafka connector of the Spark version
    in use on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    return reader.load().select(
        F.col("value").cast("string").alias("value"), F.col("offset").alias("seq")
    )


def directory_stream(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    """Parquet files of (value, seq) arriving in a directory."""
    return (
        spark.readStream.schema("value STRING, seq BIGINT").options(**options).parquet(directory)
    )


def kafka_publisher(servers: str, topic: str):
    """Publisher of (key, value) frames to a topic."""

    def publish(messages: DataFrame, name: str) -> None:
        (
            messages.write.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
            .save()
        )

    return publish


def directory_publisher(directory: str):
    """Publisher of (key, value) frames to one directory per part of a batch; a part sent again replaces itself."""

    def publish(messages: DataFrame, name: str) -> None:
        messages.write.mode("overwrite").parquet(f"{directory}/batch={name}")

    return publish
