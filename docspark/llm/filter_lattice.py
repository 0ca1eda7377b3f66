"""How filters interact: what each removes at each step of every order, and its share over all orders.

A document's failures do not depend on the order, so documents are counted by
the set of filters they fail. What a filter removes depends only on the set of
filters before it: a state of the subset lattice. The lattice has one edge per
state and next filter. Counting forward the orders that reach a state, and
backward those that leave it, weighs an edge by the orders that go through it.
The weighed removals add up to the filter's share (Shapley), and the steps of each
order are read from the same edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm import common

# The filters of `failures`: few words, repeated words, capitals, symbols, copies.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
COPY = 1 << 4
# Orders grow with the factorial of the filters.
MAX_FILTERS = 7

_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUATION = bytes(range(0x80, 0xC0))


# --- failures ----------------------------------------------------------------


def _mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails. Words end at the six white-space bytes of ASCII."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    characters = len(text.translate(None, _CONTINUATION))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * capitals > MAX_CAPITAL_PERCENT * characters,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(failed << i for i, failed in enumerate(fails))


def _read(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """`id`, `part`, `mask` of A to D and `digest` of the text, row by row."""
    empty = F.lit("")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col), empty).alias("part"),
        F.coalesce(F.col(text_col), empty).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                text = value.as_py()
                masks.append(_mask(text))
                digests.append(hashlib.sha256(text).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "mask", "digest"])

    kind = docs.schema[id_col].dataType
    fields = [("id", kind), ("part", T.StringType()), ("mask", T.IntegerType()), ("digest", T.BinaryType())]
    return common.map_in_arrow(rows, run, T.StructType([T.StructField(n, k) for n, k in fields]))


def failures(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    good: Column | None = None,
    toxic: Column | None = None,
) -> DataFrame:
    """Documents counted by `part`, `mask` of failed filters, `good` and `toxic`, as `n`.

    A text is a copy if a smaller id has the same, by SHA-256; a null id is larger
    than all others and has no label. An id is good or toxic if any of its labels
    says so. Copies are counted per part before their digests meet, so no task
    gets all copies of a text.
    """
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    says = lambda c: F.max(F.coalesce(c, F.lit(False)))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(says(good).alias("good"), says(toxic).alias("toxic"))

    rows = common.stored(_read(docs, id_col, text_col, part_col))
    same = ["part", "mask", "digest", "good", "toxic"]
    no = F.lit(False)
    marked = rows.filter("id IS NOT NULL").join(marks, "id", "left")
    marked = marked.withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    # The join has dealt rows by id, so this adds no exchange.
    single = marked.groupBy("id", *same).agg(F.count("*").alias("c"))
    nameless = rows.filter("id IS NULL").withColumns({"good": no, "toxic": no})
    nameless = nameless.groupBy("id", *same).agg(F.count("*").alias("c"))
    grouped = single.unionByName(nameless).groupBy(*same).agg(
        F.sum("c").alias("n"), F.min("id").alias("least"), F.min_by("c", "id").alias("at_least")
    )
    # One row per text, part and label: the ids are gone.
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("at_least"))
    counted = grouped.withColumn("first", first).withColumn("passing", F.coalesce(passing, F.lit(0)))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    split = counted.select("part", "good", "toxic", F.explode(both).alias("s")).select("part", "good", "toxic", "s.*")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


# --- lattice -----------------------------------------------------------------


@cache
def paths(size: int) -> tuple[list[int], list[int]]:
    """Of every set of filters: the orders that reach it from none, and those that leave it for all."""
    states = 1 << size
    forward, backward = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):
        for f in range(size):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(states)):
        for f in range(size):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def edges(counts: DataFrame, size: int) -> DataFrame:
    """Per `part`, `state` and next `filter`: its counts, and the orders through the edge."""
    forward, backward = paths(size)
    steps = [
        F.struct(
            F.lit(state).alias("state"), F.lit(f).alias("filter"),
            F.lit(forward[state] * backward[state | 1 << f]).cast("long").alias("orders"),
        )
        for state in range(1 << size) for f in range(size) if not state >> f & 1
    ]
    # An edge for every count: the lattice is of fixed size, so the rows grow only with parts.
    met = counts.select("*", F.explode(F.array(*steps)).alias("edge")).select("*", "edge.*").drop("edge")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    mask, fails = F.col("mask"), F.col("mask").bitwiseAND(bit) != 0
    earlier = mask.bitwiseAND(F.col("state")) != 0
    removed = ~earlier & fails

    def sum_of(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return met.groupBy("part", "state", "filter", "orders").agg(
        sum_of(~earlier & ~fails).alias("kept"),
        sum_of(removed).alias("removed"),
        sum_of(earlier & fails).alias("redundant"),
        sum_of(mask == bit).alias("unique_fails"),
        sum_of(removed & F.col("good")).alias("good_lost"),
        sum_of(removed & F.col("toxic")).alias("toxic_lost"),
    )


def interactions(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per `part`, `filter_order` and `step`, from counts by `part`, `mask`, `good` and `toxic`.

    Bit i of a mask is failure of filter i. Counts are of the part: `kept` after the
    step, `removed` there, `redundant` (fails, removed before), `unique_fails` (fails this
    filter only), `good_lost` and `toxic_lost` of those removed, and `shapley`, what the
    filter removes over all orders. Parts without rows do not appear.
    """
    size = len(filters)
    if not 0 < size <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    found = edges(counts, size)
    own = Window.partitionBy("part", "filter")
    weighed = found.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(own))
    walks = []
    for order in permutations(range(size)):
        state, name = 0, "".join(filters[f] for f in order)
        for step, f in enumerate(order, 1):
            walks.append((name, step, state, f))
            state |= 1 << f
    # As many rows as the orders have steps, whatever the input is.
    steps = counts.sparkSession.createDataFrame(walks, "filter_order string, step int, state int, filter int")
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return weighed.join(F.broadcast(steps), ["state", "filter"]).select("part", "filter_order", "step", *columns)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """`interactions` of the five filters on whole texts, per source.

    A null text is empty, a null source is ''. Every row counts, repeated ones too. Null
    and repeated ids as in `failures`. An empty table gives no rows. Other columns
    are not read and may have any name.
    """
    return interactions(common.stored(failures(docs, labels, **columns)))
