"""Sharding by histogram sort.

Rows are sorted by a key and cut into shards of near equal bytes. The cuts are
found by rounds of counting: probes divide the key space evenly, the exact bytes
and rows below each are summed over all partitions, and only the brackets that
still hold a cut are probed again, until each cut is within the tolerance. Then
the rows are dealt out once and sorted.

A key is followed by a hash of the text and a stored row number, so a key with a
third of all rows is cut like any other. A round sends at most `cuts * PROBES`
sums to the driver. Shards are made of smaller ranges of at most `rows_per_task`
rows or so, each sorted by a task; a row's place in its shard follows from its
place in the range and the counted rows before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm import common

SHARDS = 40
TOLERANCE = 0.001
FIRST_BITS = 12
PROBE_BITS = 6
ROWS_PER_TASK = 2_000_000
ROW_BYTES = 16

_KEY = ["_a", "_b", "_c"]
_TOP = 1 << 63


@dataclass
class Bracket:
    """Keys whose columns before `column` equal `exact` and whose bits from `shift` on are `prefix`."""

    column: int
    exact: tuple[int, ...]
    prefix: int
    shift: int
    bytes_before: int
    rows_before: int


def _unsigned(value: int) -> int:
    return value + _TOP


def _bits(column: str, shift: int) -> Column:
    """Upper bits of a signed long, in the order of the values."""
    flipped = F.col(column).bitwiseXOR(F.lit(-_TOP))
    return F.shiftrightunsigned(flipped, shift) if shift < 64 else F.lit(0).cast("long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= _TOP else value


def _counted(items: DataFrame, brackets: list[Bracket], shift: int) -> dict[int, list[tuple[int, int, int]]]:
    """Bytes and rows of each probe interval of each bracket; all brackets are of one column and shift."""
    column, above = brackets[0].column, brackets[0].shift
    spark = items.sparkSession
    fields = [*(f"_k{i}" for i in range(column)), "_prefix"]
    rows = [(n, *b.exact, _signed(b.prefix)) for n, b in enumerate(brackets)]
    opened = F.broadcast(spark.createDataFrame(rows, ", ".join(f"{f} long" for f in ["_bracket", *fields])))
    keyed = items.select(
        "_size",
        _bits(_KEY[column], above).alias("_prefix"),
        _bits(_KEY[column], shift).alias("_probe"),
        *[F.col(_KEY[i]).alias(f"_k{i}") for i in range(column)],
    )
    sums = (
        keyed.join(opened, fields)
        .groupBy("_bracket", "_probe")
        .agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    )
    found: dict[int, list[tuple[int, int, int]]] = {}
    for row in sums.collect():
        found.setdefault(row["_bracket"], []).append((row["_probe"] % (1 << 64), row["_bytes"], row["_rows"]))
    return {n: sorted(probes) for n, probes in found.items()}


def splitters(
    items: DataFrame, cuts: list[int], tolerance: int, first_bits: int = FIRST_BITS, probe_bits: int = PROBE_BITS
) -> list[tuple[tuple[int, int, int], int]]:
    """Lower key and rows below it, for each number of bytes in `cuts`.

    At most `tolerance` bytes lie between a cut and its key, or one row.
    """
    spans = items.agg(*[f(c) for c in _KEY for f in (F.min, F.max)]).first()
    # Bits that all values share need no probes.
    width = [(_unsigned(spans[2 * i]) ^ _unsigned(spans[2 * i + 1])).bit_length() for i in range(3)]
    start = lambda i: _unsigned(spans[2 * i]) >> width[i]
    open_: list[tuple[Bracket, list[int]]] = [
        (Bracket(0, (), start(0), width[0], 0, 0), list(range(len(cuts))))
    ]
    result: dict[int, tuple[tuple[int, int, int], int]] = {}
    bits = first_bits
    while open_:
        following: list[tuple[Bracket, list[int]]] = []
        for column, above in {(b.column, b.shift) for b, _ in open_}:
            group = [(b, wanted) for b, wanted in open_ if (b.column, b.shift) == (column, above)]
            shift = max(0, above - bits)
            counts = _counted(items, [b for b, _ in group], shift)
            for n, (bracket, wanted) in enumerate(group):
                before, rows, left = bracket.bytes_before, bracket.rows_before, list(wanted)
                for probe, size, count in counts[n]:
                    inside = [w for w in left if cuts[w] < before + size]
                    left = left[len(inside) :]
                    last = shift == 0 and column == len(_KEY) - 1
                    if inside and (size <= tolerance or count == 1 or last):
                        key = (*bracket.exact, (probe << shift) - _TOP, *[-_TOP] * (2 - column))
                        result.update({w: (key, rows) for w in inside})
                    elif inside and shift:
                        following.append((Bracket(column, bracket.exact, probe, shift, before, rows), inside))
                    elif inside:
                        exact = (*bracket.exact, probe - _TOP)
                        following.append(
                            (Bracket(column + 1, exact, start(column + 1), width[column + 1], before, rows), inside)
                        )
                    before, rows = before + size, rows + count
        open_, bits = following, probe_bits
    return [result[w] for w in range(len(cuts))]


def _ranges_below(bounds: list[tuple[int, int, int]]) -> Column:
    """Number of `bounds` that are no larger than a row's key, by bisection."""
    literal = F.from_json(
        F.lit(json.dumps([dict(zip("abc", b, strict=True)) for b in bounds])), "array<struct<a:bigint,b:bigint,c:bigint>>"
    )
    key = F.struct(*[F.col(c).alias(n) for c, n in zip(_KEY, "abc", strict=True)])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(literal, low + step - 1) <= key, low + step).otherwise(low),
    )


def sharded(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    rows_per_task: int = ROWS_PER_TASK,
    carry: list[str] | None = None,
) -> DataFrame:
    """Shard and place of every row, rows in the order of their ids; `carry` names columns that go along.

    Every row of `docs` has a size of its UTF-8 bytes plus ROW_BYTES. Shards hold
    consecutive ids, their bytes are equal but for the tolerance and one row.
    `slot` counts from 0 within the shard. A null id comes first, a null text
    counts as empty. Repeated rows are rows and may fall into two shards. Other
    columns are read only if they are in `carry`, under any name. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = common.stored(
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-_TOP)).alias("_a"),
            common.text_tag(F.col(text_col)).alias("_b"),
            F.monotonically_increasing_id().alias("_c"),
            (F.octet_length(text).cast("long") + ROW_BYTES).alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.struct(*[F.lit(0).alias("_none"), *(carry or [])]).alias("_carry"),
        )
    )
    total, rows = items.agg(F.sum("_size"), F.count("*")).first()
    parts = max(1, -(-rows // (shards * rows_per_task)))
    ranges = shards * parts
    cuts = [total * n // ranges for n in range(1, ranges)] if rows else []
    found = splitters(items, cuts, int(tolerance * total / shards)) if cuts else []
    before = [0, *(n for _, n in found)]
    # Rows of the shard that come before the range.
    offsets = [before[n] - before[n - n % parts] for n in range(len(before))]
    ranged = items.withColumn("_range", _ranges_below([key for key, _ in found]))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*_KEY)).cast("long") - 1
    offset = F.get(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col("_range"))
    return ranged.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.floor(F.col("_range") / parts).cast("int").alias("shard"),
        (place + offset).alias("slot"),
        *[F.col("_carry")[c].alias(c) for c in carry or []],
    )
