"""Keyed building blocks that hold up when one key has a large share of rows.

Each one cuts the rows of a key down before the shuffle (partial aggregates,
partial group limits) or splits the key over several groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RowOrder = Sequence[Column | str]


def first_rows(df: DataFrame, keys: Sequence[str], order: RowOrder, n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of every key, numbered from 1 in column ``rank``.

    The limit on the rank lets Spark drop rows beyond ``n`` in every task
    before the shuffle, so a key sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def latest_rows(df: DataFrame, keys: Sequence[str], newest_first: RowOrder) -> DataFrame:
    """Last write wins: the newest row of every key."""
    return first_rows(df, keys, newest_first, 1, "_rank").drop("_rank")


def first_as_array(
    df: DataFrame, key: str, order: RowOrder, n: int, item: Column, name: str
) -> DataFrame:
    """One row per key with its first ``n`` items as an ordered array."""
    limited = first_rows(df, [key], order, n, "_rank").select(
        key, F.struct(F.col("_rank"), item.alias("item")).alias("_ranked")
    )
    ordered = F.array_sort(F.collect_list("_ranked"))
    return limited.groupBy(key).agg(F.transform(ordered, lambda r: r["item"]).alias(name))


def numbered(
    df: DataFrame, key: str, group: str, position: str, name: str, chunk: int = 4096
) -> DataFrame:
    """Numbers the rows of a key from 1 in the order of (group, position).

    ``position`` is a non-negative integer, unique within the group; neither is
    null. Rows are ranked within (key, group, block of ``chunk`` positions), and what
    precedes a block comes from the block counts. No task ranks all rows of a
    key.
    """
    block = F.expr(f"{position} DIV {chunk}").alias("_block")
    blocks = [key, group, "_block"]
    rows = df.select("*", block)
    counts = rows.groupBy(*blocks).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy(group, "_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *blocks, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy(*blocks).orderBy(position))
    ranked = rows.withColumn("_within", within)
    return (
        ranked.join(offsets, blocks)
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_block", "_before", "_within")
    )


def joined_text(
    df: DataFrame, key: str, order: Sequence[str], text: str, separator: str, name: str
) -> DataFrame:
    """One text per key from its parts in order.

    The result is a single string per key, so a key's parts together are
    bounded by what one string can hold.
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_part"))))
    texts = F.transform(parts, lambda part: part["_part"])
    return df.groupBy(key).agg(F.array_join(texts, separator).alias(name))
