"""What the operators of this subpackage share: keys of rows, stored steps, clean-up."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators.small import shared_directory

# The white space of all contracts here: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_tag(text: Column) -> Column:
    """Tells rows of one id apart by their text; a null text has a tag of its own."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def row_key(row_id: Column, text: Column) -> Column:
    """Key of a row. Being a struct it joins and groups a null id like any other."""
    return F.struct(row_id.alias("id"), text_tag(text).alias("tag"))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever they are called."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def words(text: Column) -> Column:
    """Maximal runs of characters that are no white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers look for this library where the driver has it.

    On a cluster that does not share the driver's folders the library is shipped
    with the job, as for any Spark program in several files.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p and p != root]
    environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_in_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    on_workers(df.sparkSession)
    return df.mapInArrow(run, schema)


def _folder(spark: SparkSession) -> str:
    return f"{shared_directory(spark).rstrip('/')}/docspark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """Path on shared storage that no other step uses."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written to shared storage and read back.

    It cuts the lineage: what follows needs neither executors nor shuffle files
    of what came before.
    """
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def copied(rows: DataFrame, copies: str, step: Column, keys: list[str], dealt: bool) -> DataFrame:
    """Each row once for each of its `copies`, numbered from 0 as `_copy`.

    Numbers are made in blocks of `step`. If `dealt`, the blocks of a row go to
    many tasks, to as many as shuffles have: they are small before they are
    exploded, so their bytes must not merge them.
    """
    last = F.col(copies) - 1
    blocks = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, step)))
    if dealt:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(tasks, *keys, "_from")
    until = F.least(F.col("_from") + step - 1, last)
    return blocks.withColumn("_copy", F.explode(F.sequence(F.col("_from"), until))).drop("_from")


def release(spark: SparkSession) -> None:
    """Deletes what `stored` has written in this application.

    To be called by a job once it has written its results.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
