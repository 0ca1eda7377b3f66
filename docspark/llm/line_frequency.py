"""Quality rules on lines that many documents of one host share.

Lines are normalised and hashed. Per host, the distinct documents of each line
are counted; lines above the limit are removed, and documents that keep too few
of their words are rejected.

Copies are no evidence of boilerplate: a site's notice stands among different
lines each time, a passage of a copied document among the same. So documents of
a line count as distinct by the line that stands with it in a fixed hash order
(the lowest hash of the document's other lines). Exact copies count once, near
copies about once for each change that meets that line.

Counting is a two-step distinct count: the first shuffle deals by line and
companion, the second gets one partial count per line and task, so a line of a
third of all documents stays spread. The lines found are joined back by a
shuffled join, whose hot keys the adaptive skew join splits, and only line
numbers are gathered per document. Texts travel only if the caller selects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

MIN_DOCUMENTS = 10
MAX_SHARE = 0.005
MIN_KEPT_SHARE = 0.3


def _windows(hashes: Column) -> Column:
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW))
    at = lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)])
    return F.coalesce(F.transform(starts, at), F.array().cast("array<bigint>"))


def _with_covered(rows: DataFrame) -> DataFrame:
    """Adds `_covered`: the words that the windows found more than once cover.

    Each step is a column of its own, as an expression within a lambda would be
    computed for every element. Only texts with a repeated window are sorted.
    """
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(repeats, placed)).drop("_windows")
    hash_at = lambda i: F.get("_placed", i)["h"]
    twice = lambda x, i: F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)) | F.coalesce(
        hash_at(i - 1) == x["h"], F.lit(False)
    )
    flagged = F.transform(F.filter("_placed", twice), lambda x: x["i"])
    rows = rows.withColumn("_places", F.sort_array(flagged)).drop("_placed")
    gaps = F.transform(
        "_places",
        lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW))),
    )
    total = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    return rows.withColumn("_covered", F.coalesce(total, F.lit(0)).cast("long")).drop("_places")


def base_metrics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row key, the row itself and the counts of a text that need no other text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(
        common.row_key(F.col(id_col), F.col(text_col)).alias("_key"),
        common.whole_row(docs).alias("_row"),
        text.alias("_text"),
        common.words(text).alias("_words"),
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: common.without(line, common.SPACES) != "")
    hashed = plain.select(
        "_key",
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(common.without(F.col("_text"), common.SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(common.without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windowed = hashed.withColumn("_windows", _windows(F.col("_hashes"))).drop("_hashes")
    counted = _with_covered(windowed).select(
        "_key",
        "_row",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_covered").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    """Case, digits and white space do not tell lines apart."""
    return F.translate(F.lower(F.trim(F.regexp_replace(line, common.SPACE_CLASS + "+", " "))), "123456789", "000000000")


def line_hash(line: Column) -> Column:
    """60 bits that other engines compute alike."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per line that has a word: row key, host, place, hash and companion."""
    split = docs.select(
        common.row_key(F.col(id_col), F.col(text_col)).alias("_key"),
        F.col(host_col).cast("string").alias("_host"),
        F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), normal_line).alias("_lines"),
    )
    hashed = split.select(
        "_key",
        "_host",
        F.transform("_lines", lambda x: F.when(x != "", line_hash(x))).alias("_hashes"),
        F.transform("_lines", lambda x: F.size(F.split(x, " "))).alias("_sizes"),
    )
    least = F.sort_array(F.array_distinct(F.array_compact("_hashes")))
    ranked = hashed.select(
        "*", F.get(least, F.lit(0)).alias("_first"), F.get(least, F.lit(1)).alias("_second")
    )
    rows = ranked.select(
        "_key",
        F.coalesce("_host", F.lit("")).alias("_host"),
        "_first",
        "_second",
        F.posexplode(F.arrays_zip("_hashes", "_sizes")).alias("_pos", "_line"),
    ).filter("_line._hashes IS NOT NULL")
    other = F.when(F.col("_line._hashes") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return rows.select(
        "_key",
        "_host",
        "_pos",
        F.col("_line._hashes").alias("_hash"),
        F.col("_line._sizes").alias("_size"),
        F.coalesce(other, F.col("_line._hashes")).alias("_other"),
    )


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_documents: int, max_share: float) -> DataFrame:
    """`_host`, `_hash` and `_documents` of the lines above the limits."""
    counts = lines.groupBy("_host", "_hash").agg(F.count_distinct("_other").alias("_documents"))
    many = counts.filter(F.col("_documents") >= min_documents)
    return many.join(hosts, "_host").filter(F.col("_documents") >= max_share * F.col("_host_rows")).drop("_host_rows")


def line_frequency(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_kept_share: float = MIN_KEPT_SHARE,
) -> DataFrame:
    """Verdict, counts and cleaned text of every row of `docs`.

    A line is above the limits if at least `min_documents` distinct documents of
    its host and at least `max_share` of the host's rows have it. A row is
    rejected if it fails the base rules or fewer than `min_kept_share` of its
    words are left. `clean_text` is the text without the removed lines.

    A null text has no words and fails the base rules; its `clean_text` is null.
    Rows without a host are one host. Repeated rows each get the same verdict,
    and as they have the same lines they count as one document. Other columns are
    not read and may have any name. An empty table gives no rows.
    """
    lines = _lines(docs, id_col, text_col, host_col)
    hosts = docs.groupBy(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host")).agg(
        F.count("*").alias("_host_rows")
    )
    frequent = frequent_lines(lines, hosts, min_documents, max_share)
    hits = lines.select("_key", "_host", "_pos", "_size", "_hash").join(frequent, ["_host", "_hash"])
    removed = hits.groupBy("_key").agg(F.collect_set(F.struct("_pos", "_size")).alias("_removed"))
    lost = F.aggregate("_removed", F.lit(0), lambda total, x: total + x["_size"])
    removed = removed.select(
        "_key", lost.cast("long").alias("_lost"), F.transform("_removed", lambda x: x["_pos"]).alias("_places")
    )
    rows = base_metrics(docs, id_col, text_col).join(removed, "_key", "left")
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    text = F.col("_row")[text_col]
    rows = rows.withColumn("_split", F.when(F.col("_places").isNotNull(), F.split(text, "\n")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_places"))
    cleaned = F.when(F.col("_split").isNull(), text).otherwise(
        F.concat_ws("\n", F.transform(places, lambda i: F.get("_split", i)))
    )
    return rows.select(
        F.col("_row")[id_col].alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (left >= min_kept_share * F.col("n_words"))).alias("kept"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce("_lost", F.lit(0).cast("long")).alias("n_removed_words"),
        cleaned.alias("clean_text"),
        F.col("_row").alias("row"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, less the removed lines."""
    # Stored, as a filter that is pushed below the counts would compute them within its lambdas.
    verdicts = line_frequency(docs, id_col, text_col, **options).select("kept", "clean_text", "row")
    judged = common.stored(verdicts).filter("kept")
    value = lambda c: F.col("clean_text") if c == text_col else F.col("row")[c]
    return judged.select(*[value(c).alias(c) for c in docs.columns])
