"""Training-order materialisation: every sequence gets a global slot and a fixed place in a file.

Texts or token ids are cut into sequences of a fixed length. Sequences are
numbered without gaps, in an order that only depends on ids and texts. A keyed
Feistel permutation maps numbers to slots; as its domain is a power of four, a
number that leaves the range is permuted again until it is back (cycle-walking),
so slots have no gaps either. Rows are dealt out by ranges of slots and each shard
is written as one file of records of a fixed stride, in the order of the slots:
slot s is in shard s // rows at byte (s % rows) * stride.

The permutation needs no table and no sort of all sequences, and any part of the
order can be read again from any slot on. Numbers are counts before a hash range
plus counts within it; ranges are even whatever the ids are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm import common
from docspark.operators.small import broadcast_if_small

ROUNDS = 6
RANGES = 4096
LENGTH = 512
# No UTF-8 text has this byte, so it fills up the last sequence of a text.
FILL = 0xFF
ROWS_PER_SHARD = 32_768
# Every record ends with this byte; readers go by the stride and never look for it.
END = "\n"
MAX_ROWS = 2_000_000
# Copies of a repeated row are numbered in blocks of so many sequences, or of one copy.
BLOCK = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """Keyed bijection of the numbers below `size`."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.half = np.uint64(max(1, math.ceil(max(1, (size - 1).bit_length()) / 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = _mixed(np.uint64(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=np.uint64))

    def _feistel(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & self.mask)
        return (left << self.half) | right

    def _swapped(self, x: np.ndarray) -> np.ndarray:
        return ((x & self.mask) << self.half) | (x >> self.half)

    def _walked(self, x: np.ndarray, step) -> np.ndarray:
        x = step(x.astype(np.uint64))
        while (outside := x >= self.size).any():
            x[outside] = step(x[outside])
        return x.astype(np.int64)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return self._walked(numbers, lambda x: self._feistel(x, self.keys))

    def number(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: halves swapped, the rounds run backwards."""
        return self._walked(slots, lambda x: self._swapped(self._feistel(self._swapped(x), self.keys[::-1])))


def slot_of(number: Column, size: int, key: int) -> Column:
    permutation = Permutation(size, key)

    @F.pandas_udf(T.LongType())
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.slot(numbers.to_numpy()))

    return slot(number)


def byte_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`_key`, `_id`, `_payload` and its sequences `_n`: the UTF-8 bytes of a text, filled up to whole sequences."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        common.row_key(F.col(id_col), F.col(text_col)).alias("_key"),
        F.col(id_col).alias("_id"),
        data.alias("_payload"),
        F.ceil(F.octet_length(text_col).cast("long") / length).cast("long").alias("_n"),
    ).filter("_n > 0")


def id_sequences(
    docs: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", length: int = LENGTH, width: int = 4, fill: int = 0
) -> DataFrame:
    """Like `byte_sequences`, of token ids as little-endian numbers of `width` bytes; `length` counts ids."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for row in batch.column(1):
                ids = np.zeros(0, dtype=kind) if row.values is None else row.values.to_numpy().astype(kind)
                data.append(np.pad(ids, (0, -len(ids) % length), constant_values=fill).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["_id", "_payload"])

    made = common.map_in_arrow(
        docs.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")),
        run,
        f"_id {dict(docs.dtypes)[id_col]}, _payload binary",
    )
    tag = F.xxhash64("_payload")
    size = (F.octet_length("_payload") / (length * width)).cast("long")
    return made.select(
        F.struct(F.col("_id").alias("id"), tag.alias("tag")).alias("_key"), "_id", "_payload", size.alias("_n")
    ).filter("_n > 0")


def numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """First number of each `_key` and its copies; the count of all numbers; the most that one repeated row has.

    Numbers follow hash ranges, hashes and keys. Rows of one key follow each other.
    """
    keys = rows.groupBy("_key").agg(F.max("_n").alias("_n"), F.count("*").alias("_copies"))
    hashed = keys.withColumn("_hash", F.xxhash64("_key")).withColumn("_range", F.pmod("_hash", F.lit(RANGES)))
    kept = common.stored(hashed)
    # One row per range: at most RANGES.
    size = F.col("_n") * F.col("_copies")
    repeated = F.max(F.when(F.col("_copies") > 1, size)).alias("_most")
    sizes = kept.groupBy("_range").agg(F.sum(size).alias("_size"), repeated).collect()
    most = max((row["_most"] or 0 for row in sizes), default=0)
    before, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["_range"]):
        before[row["_range"]], total = total, total + row["_size"]
    offsets = F.broadcast(
        rows.sparkSession.createDataFrame(sorted(before.items()), "_range long, _offset long")
    )
    within = Window.partitionBy("_range").orderBy("_hash", "_key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(size).over(within), F.lit(0))
    placed = kept.withColumn("_earlier", earlier).join(offsets, "_range")
    return placed.select("_key", (F.col("_offset") + F.col("_earlier")).alias("_first"), "_copies"), total, most


def ordered(rows: DataFrame, stride: int, fill: int, key: int) -> tuple[DataFrame, int]:
    """`_slot`, `_id`, `_part`, `_size` and `_record` of every sequence, and their count.

    `stride` is the bytes of a record. A row that is repeated has sequences of its
    own for each copy.
    """
    common.on_workers(rows.sparkSession)
    first, total, most = numbered(rows)
    first = broadcast_if_small(common.stored(first), max_rows=MAX_ROWS)
    start = F.col("_first")
    if most:
        step = F.greatest(F.lit(1), F.floor(BLOCK / F.col("_n"))).cast("long")
        whole = rows.dropDuplicates(["_key"]).join(first, "_key")
        whole = common.copied(whole, "_copies", step, ["_key"], dealt=most > BLOCK)
        start = start + F.col("_copy") * F.col("_n")
    else:
        whole = rows.join(first, "_key")

    def piece(part: Column) -> Column:
        data = F.substring("_payload", (part * stride + 1).cast("int"), F.lit(stride))
        record = F.rpad(data, stride, F.lit(bytes([fill])))
        return F.struct(
            (start + part).alias("number"),
            part.alias("part"),
            F.octet_length(data).alias("size"),
            record.alias("record"),
        )

    # The pieces of one copy are cut before they become rows, so no row of a piece carries the whole text.
    parts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    cut = whole.select("_id", F.explode(F.transform(parts, piece)).alias("_piece"))
    return cut.select(
        slot_of(F.col("_piece.number"), max(total, 1), key).alias("_slot"),
        "_id",
        F.col("_piece.part").alias("_part"),
        F.col("_piece.size").alias("_size"),
        F.col("_piece.record").alias("_record"),
    ), total


def write_shards(rows: DataFrame, total: int, path: str, rows_per_shard: int = ROWS_PER_SHARD) -> None:
    """Writes `_record` of every `_slot` to one file per shard, under `path`/shard=number.

    A task writes the whole shards of its range of slots; files appear when the
    job commits, so lost executors and repeated tasks leave no part of a shard.
    """
    shards = max(1, -(-total // rows_per_shard))
    shard = F.floor(F.col("_slot") / rows_per_shard).cast("int")
    placed = rows.select("_slot", F.col("_record").cast("string").alias("value"))
    # Slots are even, so the ranges are known and need no sample of the rows.
    dealt = placed.repartition(shards, shard).withColumn("shard", shard)
    ranged = dealt.sortWithinPartitions("shard", "_slot").drop("_slot")
    ranged.write.partitionBy("shard").option("lineSep", END).text(path)


def read_shards(
    spark: SparkSession, path: str, stride: int, first: int = 0, rows_per_shard: int = ROWS_PER_SHARD
) -> DataFrame:
    """`slot`, `shard`, `offset` and `record` of the slots from `first` on; earlier shards are not opened.

    A shard, of bounded size, is read as a whole.
    """
    schema = "path string, modificationTime timestamp, length long, content binary, shard int"
    files = spark.read.format("binaryFile").schema(schema).load(path)
    step = stride + len(END)
    rows = files.filter(F.col("shard") >= first // rows_per_shard).select(
        "shard",
        "content",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / step) - 1)).alias("_row"),
    )
    return rows.select(
        (F.col("shard").cast("long") * rows_per_shard + F.col("_row")).alias("slot"),
        "shard",
        (F.col("_row") * step).alias("offset"),
        F.substring("content", (F.col("_row") * step + 1).cast("int"), F.lit(stride)).alias("record"),
    ).filter(F.col("slot") >= first)


def materialised(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    key: int = 0,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """Writes the byte sequences of all texts in training order and returns their index.

    One row per sequence: `slot`, `shard`, `offset`, id, `part` within the text,
    `n_bytes` that are no filling, and the checksum of the record. All records are
    read back and compared by place and checksum; a difference is an error. A
    null or empty text has no sequence, a repeated row has sequences of its own, a
    null id is an id like any other. Other columns are not read and may have any
    name. An empty table gives no rows and no files.
    """
    rows, total = ordered(byte_sequences(docs, id_col, text_col, length), length, FILL, key)
    index = rows.select(
        F.col("_slot").alias("slot"),
        F.floor(F.col("_slot") / rows_per_shard).cast("int").alias("shard"),
        (F.col("_slot") % rows_per_shard * (length + len(END))).alias("offset"),
        F.col("_id").alias(id_col),
        F.col("_part").alias("part"),
        F.col("_size").alias("n_bytes"),
        F.crc32("_record").alias("record_crc32"),
    )
    if total:
        write_shards(rows, total, path, rows_per_shard)
        back = read_shards(docs.sparkSession, path, length, 0, rows_per_shard)
        if _digest(back.withColumn("record_crc32", F.crc32("record"))) != _digest(index):
            raise RuntimeError(f"the shards under {path} are not what was written")
    return index


def _digest(records: DataFrame) -> tuple:
    """Number and sum of hashes of place and checksum of all records, in whatever order."""
    place = F.xxhash64("slot", "shard", "offset", "record_crc32")
    return tuple(records.agg(F.count("*"), F.sum(place.cast("decimal(38,0)"))).first())
