"""Results that are needed more than once, and joins with sides checked small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"
# A master of several processes, as local-cluster, is none.
_LOCAL_MASTER = re.compile(r"local(\[[^\]]*\])?")
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def shared_directory(spark: SparkSession) -> str:
    """Folder all executors see, as named by the session.

    Where none is named, a temporary one is made if driver and executors are one
    process on this machine, and an error is raised on a cluster.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not _LOCAL_MASTER.fullmatch(context.master):
            raise ValueError(f"{_CHECKPOINT_DIR} must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docspark-"))
    return context.getCheckpointDir()


def new_base(spark: SparkSession) -> str:
    """A folder of its own on the storage executors share."""
    return f"{shared_directory(spark)}/docspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written as a table on shared storage and read back, by columns where it is read more than once."""
    location = f"{new_base(df.sparkSession)}/rows"
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def materialised(df: DataFrame) -> DataFrame:
    """The frame computed once and kept on shared storage."""
    directory = shared_directory(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(directory)
    return df.checkpoint(eager=True)


def evened(df: DataFrame) -> DataFrame:
    """The rows in parts of about equal bytes, wherever they come from; how many, the session decides.

    Work after it is not held up by the largest part of a file or by one of many tables.
    """
    return df.hint("rebalance")


def is_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether a frame is measured to be small enough for broadcast; at most ``max_rows`` + 1 rows are counted."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    measured = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return measured[0] <= max_rows and measured[1] <= max_bytes


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Marks a materialised frame for broadcast if it is measured to be small.

    A larger one is left to a shuffled join, where the adaptive skew join
    splits hot keys.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
