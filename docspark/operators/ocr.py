"""Cleaning and assembly of recognised words, lines and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import patterns as P
from docspark.functions.text import strip
from docspark.operators import keyed
from docspark.operators.small import stored

_GEOMETRY = ("left", "top", "width", "height")


def words_from_arrays(pages: DataFrame) -> DataFrame:
    """Word rows from one row per page with parallel arrays (a TSV by column); other columns are kept."""
    columns = ("text", "conf", *_GEOMETRY)
    others = [name for name in pages.columns if name not in ("doc_id", "page", *columns)]
    zipped = F.arrays_zip(*columns)
    return pages.select("doc_id", *others, "page", F.posexplode(zipped).alias("pos", "_word")).select(
        "doc_id", *others, "page", "pos", *(F.col(f"_word.{name}").alias(name) for name in columns)
    )


def blocks_from_results(results: DataFrame) -> DataFrame:
    """Block rows from result pages that continue each other.

    ``result_no`` counts the pages of one answer; (result_no, pos) is the order
    of the blocks.
    """
    return results.select("doc_id", "result_no", F.posexplode("blocks").alias("pos", "_b")).select(
        "doc_id", "result_no", "pos", "_b.*"
    )


def clean_words(words: DataFrame) -> DataFrame:
    """Drops blank words and words without a confidence of at least 0; other columns are kept."""
    others = [name for name in words.columns if name not in ("doc_id", "page", "pos", "text", "conf", *_GEOMETRY)]
    confidence = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    return (
        words.withColumn("text", strip(F.col("text")))
        .withColumn("confidence", confidence)
        .filter((F.col("text") != "") & (F.col("confidence") >= 0))
        .select(
            "doc_id",
            *others,
            "page",
            "pos",
            "text",
            *(F.col(name).try_cast("int").alias(name) for name in _GEOMETRY),
            (F.col("confidence") / 100.0).alias("confidence"),
        )
    )


def clean_lines(blocks: DataFrame) -> DataFrame:
    """LINE blocks with defaults for what the service left out."""
    empty_box = F.struct(
        *(F.lit(None).cast("double").alias(n) for n in ("Left", "Top", "Width", "Height"))
    )
    return blocks.filter(F.col("BlockType") == "LINE").select(
        "doc_id",
        "result_no",
        "pos",
        F.lit("LINE").alias("type"),
        F.coalesce("Text", F.lit("")).alias("text"),
        (F.coalesce("Confidence", F.lit(0.0)) / 100.0).alias("confidence"),
        F.coalesce("Page", F.lit(1)).alias("page"),
        F.coalesce("bbox", empty_box).alias("bbox"),
    )


def page_text(pages: DataFrame) -> DataFrame:
    """Document text: stripped page texts in page order, blank line between."""
    stripped = pages.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    return keyed.joined_text(stripped, "doc_id", ["page"], "text", "\n\n", "text")


def line_text(lines: DataFrame) -> DataFrame:
    """Document text: lines in block order, one per line."""
    return keyed.joined_text(lines, "doc_id", ["result_no", "pos"], "text", "\n", "text")


def layout_boxes(words: DataFrame) -> DataFrame:
    """All word boxes of a document, numbered over its pages."""
    return keyed.numbered(words, "doc_id", "page", "pos", "box_no")


def boxes_of_pages(pages: DataFrame) -> DataFrame:
    """All word boxes of whole pages with parallel arrays, numbered over the pages of a document.

    The words a page keeps are stored once. Only the counts of pages are summed up in
    the order of a document's pages; the words follow their page, so the pages of a
    document are numbered by many tasks.
    """
    found = F.filter(F.array(_kept_words()), lambda words: F.size(words) > 0)
    kept = pages.select("doc_id", "page", F.explode(found).alias("_kept"))
    rows = stored(kept.withColumn("_n", F.size("_kept")))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("doc_id", "page", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.join(offsets, ["doc_id", "page"]).select("doc_id", "page", "_before", F.posexplode("_kept"))
    return numbered.select(
        "doc_id",
        "page",
        "col.text",
        (F.col("col.confidence") / 100.0).alias("confidence"),
        *(F.col(f"col.{name}").try_cast("int").alias(name) for name in _GEOMETRY),
        (F.col("_before") + F.col("pos") + 1).alias("box_no"),
    )


def layout_block(columns: list[str]) -> Column:
    """A row as a layout block; columns the source lacks are null."""
    return F.struct(
        *(
            (F.col(field.name) if field.name in columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schemas.LAYOUT_BLOCK.fields
        )
    )


def layout_summary(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Number of blocks and the first of them, per document."""
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("line_count"))
    first = keyed.first_as_array(
        blocks,
        "doc_id",
        order,
        P.MAX_LAYOUT_LINES,
        layout_block(blocks.columns),
        "layout_lines",
    )
    return counts.join(first, "doc_id")


def _blocks_of(rows: DataFrame, order: str, kept: Column, block) -> DataFrame:
    """doc_id, order, n and the first blocks of each page, from the array column ``kept``.

    Every page is cut where it stands: no row per block, and no shuffle of them. Pages
    without blocks are dropped in the generator, as a filter would be pushed below the
    projection and work out ``kept`` once more.
    """

    def cut(found: Column) -> Column:
        first = F.slice(found, 1, P.MAX_LAYOUT_LINES)
        return F.struct(F.size(found).cast("bigint").alias("n"), F.transform(first, block).alias("blocks"))

    page = F.filter(F.transform(F.array(kept), cut), lambda p: p["n"] > 0)
    return rows.withColumn("order", F.col(order)).select("doc_id", "order", F.inline(page))


def _as_layout_block(**values: Column) -> Column:
    """A layout block of the given values, null where there is none."""
    return F.struct(
        *(
            values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schemas.LAYOUT_BLOCK.fields
        )
    )


def _kept_words() -> Column:
    """The words of a page's parallel arrays that ``clean_words`` keeps, confidence still in percent."""
    words = F.transform(
        F.arrays_zip("text", "conf", *_GEOMETRY),
        lambda w: F.struct(
            strip(w["text"]).alias("text"),
            F.coalesce(w["conf"].try_cast("double"), F.lit(-1.0)).alias("confidence"),
            *(w[name].alias(name) for name in _GEOMETRY),
        ),
    )
    return F.filter(words, lambda w: (w["text"] != "") & (w["confidence"] >= 0))


def word_pages(pages: DataFrame) -> DataFrame:
    """``clean_words`` of pages with parallel arrays, counted and cut to the first blocks of each page."""

    def block(w: Column) -> Column:
        geometry = {name: w[name].try_cast("int") for name in _GEOMETRY}
        return _as_layout_block(
            page=F.col("order"), text=w["text"], confidence=w["confidence"] / 100.0, **geometry
        )

    return _blocks_of(pages, "page", _kept_words(), block)


def line_pages(results: DataFrame) -> DataFrame:
    """``clean_lines`` of result pages, counted and cut to the first blocks of each page."""
    empty_box = F.struct(
        *(F.lit(None).cast("double").alias(n) for n in ("Left", "Top", "Width", "Height"))
    )
    kept = F.filter("blocks", lambda b: b["BlockType"] == "LINE")

    def block(b: Column) -> Column:
        return _as_layout_block(
            type=F.lit("LINE"),
            text=F.coalesce(b["Text"], F.lit("")),
            confidence=F.coalesce(b["Confidence"], F.lit(0.0)) / 100.0,
            page=F.coalesce(b["Page"], F.lit(1)),
            bbox=F.coalesce(b["bbox"], empty_box),
        )

    return _blocks_of(results, "result_no", kept, block)


def layout_of_pages(pages: DataFrame) -> DataFrame:
    """``layout_summary`` of pages that are counted and cut: one aggregation over one row per page.

    A page brings at most as many blocks as the summary keeps, with an array per field, as
    structs take more bytes in a shuffle. The pages of a document meet in one task, as
    those of its text do.
    """
    names = schemas.LAYOUT_BLOCK.names
    columns = F.struct(*(F.col(f"blocks.{name}").alias(name) for name in names))

    def blocks(page: Column) -> Column:
        zipped = F.arrays_zip(*(page["columns"][name] for name in names))
        return zipped.cast(f"array<{schemas.LAYOUT_BLOCK.simpleString()}>")

    ordered = F.array_sort(F.transform("_pages", lambda p: F.struct(p["order"], blocks(p).alias("blocks"))))
    first = F.slice(F.flatten(F.transform(ordered, lambda p: p["blocks"])), 1, P.MAX_LAYOUT_LINES)
    by_columns = pages.select("doc_id", "n", F.struct("order", columns.alias("columns")).alias("_page"))
    grouped = by_columns.groupBy("doc_id").agg(F.sum("n").alias("line_count"), F.collect_list("_page").alias("_pages"))
    return grouped.select("doc_id", "line_count", first.alias("layout_lines"))


def text_or_sentinel(text: Column, status: Column, message: Column) -> Column:
    """Text of a read document, or the text that marks why it was not read.

    The mark is processed like any other text.
    """
    return (
        F.when(status == "unreadable_image", P.UNREADABLE_IMAGE)
        .when(status == "no_pdf_renderer", P.NO_PDF_RENDERER)
        .when(status == "pdf_failed", F.format_string(P.PDF_FAILED, F.coalesce(message, F.lit(""))))
        .otherwise(F.coalesce(text, F.lit("")))
    )
