"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: what its weight asks for, over what it
has. A document's number of copies is a Poisson variate with that mean, found by
inverting the distribution at a uniform number that a hash of seed and document
gives; so it is the same on every run and needs no state. Documents are exploded
by their count and dealt out by a hash of document and copy.

Sizes of sources are partial sums, so a source of a third of all rows is no hot
task. Rates are a row per source and are broadcast if measured small, else joined
by a shuffle whose hot keys the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.operators.small import broadcast_if_small

# A mean above this is drawn as a sum of independent parts, each inverted alone.
MAX_MEAN = 16.0
# Terms of the distribution; beyond these the mass is below 1e-40 for MAX_MEAN.
TERMS = 100
TEMPERATURE = 0.5


def uniform(*parts: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) of a Poisson variate for k below TERMS."""
    start = F.struct(
        F.exp(-mean).alias("term"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")
    )

    def add(state: Column, k: Column) -> Column:
        total = state["sum"] + state["term"]
        return F.struct(
            (state["term"] * mean / (k + 1)).alias("term"),
            total.alias("sum"),
            F.concat(state["all"], F.array(total)).alias("all"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, add, lambda state: state["all"])


def source_rates(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    targets: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
) -> DataFrame:
    """`_source`, `rate`, the parts a variate is drawn in and the distribution of one part.

    The size of a row is its UTF-8 bytes and one separator. `targets` has a row of
    `source` and `weight` per source; a source that it does not name has weight 0.
    Without it the weight is the size to the power of `temperature`. The expected
    size of the mix is `epochs` times the input.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    key = F.struct(F.col(source_col).cast("string").alias("source"))
    sizes = docs.groupBy(key.alias("_source")).agg(F.sum(size).alias("_size"))
    if targets is None:
        weighted = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(temperature)))
    else:
        named = targets.select(
            F.struct(F.col("source").cast("string").alias("source")).alias("_source"),
            F.col("weight").cast("double").alias("_weight"),
        )
        weighted = sizes.join(named, "_source", "left").fillna(0.0, ["_weight"])
    weighted = common.stored(weighted)
    total, weights = weighted.agg(F.sum("_size"), F.sum("_weight")).first()
    share = F.col("_weight") / F.lit(float(weights or 1.0) or 1.0)
    rated = weighted.withColumn("rate", share * F.lit(float(total or 0) * epochs) / F.col("_size"))
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int")
    rated = rated.withColumn("_parts", parts)
    return rated.select("_source", "rate", "_parts", cumulative(F.col("rate") / F.col("_parts")).alias("_cdf"))


def replicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    **options,
) -> DataFrame:
    """The rows of `docs` as struct `row`, once per copy, in a global random order.

    `copies` is the row's number of copies, `copy` the number of this one,
    `shuffle_key` its place in [0, 1): partitions are dealt by it and sorted by
    it. Rows of one id draw the same number, and so do repeated rows; a null id
    is replaced by a digest of the text. A null source is a source, null and
    empty texts count one byte. Other columns may have any name. An empty table
    gives no rows.
    """
    rates = broadcast_if_small(common.stored(source_rates(docs, source_col, text_col, **options)))
    identity = F.coalesce(
        F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    )
    keyed = docs.select(
        F.struct(F.col(source_col).cast("string").alias("source")).alias("_source"),
        identity.alias("_identity"),
        common.whole_row(docs).alias("row"),
    )
    drawn = keyed.join(rates, "_source").withColumn(
        "_draws",
        F.transform(
            F.sequence(F.lit(1), F.col("_parts")),
            lambda part: uniform(F.lit(seed), F.lit("draw"), F.col("_identity"), part),
        ),
    )
    below = lambda u: F.size(F.filter("_cdf", lambda p: p <= u))
    copies = F.aggregate("_draws", F.lit(0), lambda total, u: total + below(u))
    counted = drawn.withColumn("copies", copies).filter("copies > 0")
    exploded = counted.select(
        "row", "rate", "copies", "_identity", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    placed = exploded.withColumn(
        "shuffle_key", uniform(F.lit(seed), F.lit("place"), F.col("_identity"), F.col("copy"))
    ).drop("_identity")
    return placed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The replicated rows with the columns of `docs`, shuffled."""
    return replicated(docs, **options).select(*[F.col("row")[c].alias(c) for c in docs.columns])
