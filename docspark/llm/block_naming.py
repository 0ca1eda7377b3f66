"""Exact dedup by deterministic block naming.

A text without its white space is cut into blocks of a fixed size. Equal blocks
get one integer name by sorting; then adjacent pairs of names are named in the
same way until each document has a single name. Names stand for the texts
themselves: no two texts share one, whatever hashes collide.

Every name is the position among the sorted keys of one of `RANGES` hash ranges,
so no task sorts more than its ranges. Equal keys are reduced before the shuffle.
Names come back to their occurrences by a join whose hot keys the adaptive skew
join splits. A level is stored before the next one starts, and the number of
levels is the logarithm of the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm import common

BLOCK = 4096
RANGES = 1 << 16
_KEY = ["_id", "_tag", "_chars", "_sha"]


def normalised(text: Column) -> Column:
    return common.without(F.coalesce(text, F.lit("")), common.SPACES)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, block: int, key: Column) -> DataFrame:
    """One row per block: row key, n blocks of the row, position, text and hash of the block."""
    plain = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        normalised(F.col(text_col)).alias("_norm"),
    )
    cut = plain.select(
        "_id",
        common.text_tag(F.col("_text")).alias("_tag"),
        F.length("_text").alias("_chars"),
        F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha"),
        F.when(F.col("_norm") == "", F.array(F.lit("")))
        .otherwise(F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
        .alias("_blocks"),
    )
    parts = cut.select(*_KEY, F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_pos", "_block"))
    return parts.withColumn("_hash", key)


def _ranked(keys: DataFrame, order: list[str], size: Column) -> DataFrame:
    """Adds `_base`: the first of `size` names of each row, by its place in its hash range."""
    by_range = Window.partitionBy("_range").orderBy(*order)
    before = F.coalesce(F.sum(size).over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = keys.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(RANGES)))
    return ranged.select(
        "*", (F.shiftleft(F.col("_range").cast("long"), 44) + before.cast("long")).alias("_base")
    ).drop("_range")


def _named_blocks(docs: DataFrame, id_col: str, text_col: str, block: int, key: Column) -> DataFrame:
    parts = _occurrences(docs, id_col, text_col, block, key)
    texts = parts.groupBy("_hash").agg(F.collect_set("_block").alias("_texts"))
    sizes = texts.select(
        "_hash",
        F.size("_texts").alias("_size"),
        F.when(F.size("_texts") > 1, F.sort_array("_texts")).alias("_texts"),
    )
    names = common.stored(_ranked(sizes, ["_hash"], F.col("_size")))
    # Repeated rows become one with a count; the text of the block stays behind.
    rows = parts.groupBy(*_KEY, "_n", "_pos", "_hash").agg(F.count("*").alias("_rows"))
    named = rows.join(names.select("_hash", "_base"), "_hash").withColumn("_name", F.col("_base"))
    collided = names.filter("_size > 1").select("_hash", "_texts")
    if not collided.isEmpty():
        # Different blocks under one hash: look the block up among the sorted texts.
        at = F.struct(*_KEY, "_pos").alias("_at")
        place = parts.join(collided, "_hash").select(
            at, (F.array_position("_texts", F.col("_block")) - 1).alias("_place")
        )
        named = named.withColumn("_at", at).join(place.distinct(), "_at", "left")
        named = named.withColumn("_name", F.col("_base") + F.coalesce("_place", F.lit(0)))
    return named.select(*_KEY, "_rows", "_n", "_pos", "_name")


def _paired(level: DataFrame) -> DataFrame:
    """Names of adjacent pairs; an odd last name is paired with nothing."""
    side = lambda odd: F.max(F.when(F.col("_pos") % 2 == odd, F.col("_name")))
    pairs = level.groupBy(
        *_KEY, "_rows", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.shiftright("_pos", 1).alias("_pos")
    ).agg(side(0).alias("_a"), F.coalesce(side(1), F.lit(-1)).alias("_b"))
    names = _ranked(pairs.select("_a", "_b").distinct(), ["_a", "_b"], F.lit(1))
    named = pairs.join(names, ["_a", "_b"])
    return named.select(*_KEY, "_rows", "_n", "_pos", F.col("_base").alias("_name"))


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key: Column | None = None
) -> DataFrame:
    """`_id`, `_tag`, `_chars`, `_sha`, `_rows` and the identity (`_level`, `_name`) of each text.

    `key` is the 64-bit hash that blocks are first sorted by; tests give a poor one.
    """
    key = F.xxhash64("_block") if key is None else key
    level = common.stored(_named_blocks(docs, id_col, text_col, block, key))
    longest = level.agg(F.max("_n")).first()[0] or 1
    done, depth = [], 0
    while True:
        single = level.filter("_n = 1").select(*_KEY, "_rows", "_name", F.lit(depth).alias("_level"))
        done.append(single)
        if longest == 1:
            break
        level = common.stored(_paired(level.filter("_n > 1")))
        longest, depth = -(-longest // 2), depth + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: its group of equal texts and whether it stays.

    Texts are equal when identical without their white space; null counts as
    empty. Of a group, the row with most code points stays, then the smallest id
    (a null id last), then the smallest text hash. Rows repeated with id and text
    are rows of the group, and the first of them may stay. Other columns of
    `docs` are not read and may have any name. An empty table gives no rows.
    """
    rows = identities(docs, id_col, text_col, **options)
    order = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("u"), F.col("_id").alias("i"), F.col("_tag").alias("t"))
    groups = rows.groupBy("_level", "_name").agg(F.min(order).alias("_best"), F.sum("_rows").alias("group_size"))
    joined = rows.join(groups, ["_level", "_name"])
    many = not rows.filter(F.col("_rows") > BLOCK).isEmpty()
    copies = common.copied(joined, "_rows", F.lit(BLOCK).cast("long"), ["_id", "_tag"], dealt=many)
    first = F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_tag") == F.col("_best.t")) & (F.col("_copy") == 0)
    return copies.select(
        F.col("_id").alias(id_col),
        F.col("_best.i").alias("keep_id"),
        "group_size",
        first.alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_tag").alias("text_tag"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; one row where a row is repeated."""
    groups = exact_groups(docs, id_col, text_col)
    key = F.struct(F.col(id_col).alias("id"), F.col("text_tag").alias("tag"))
    kept = groups.filter("kept").select(key.alias("_row_key"))
    keyed = docs.withColumn("_row_key", common.row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    # Both steps are dealt by the same key: the rows are shuffled once.
    return keyed.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).drop("_row_key")
