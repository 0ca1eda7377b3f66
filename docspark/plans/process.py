"""From upload events to processed documents, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import keyed
from docspark.operators.doctype import with_doc_type
from docspark.operators.entities import answered_entities, answered_key_phrases, enriched
from docspark.operators.entities import grouped_entities, grouped_key_phrases
from docspark.operators.fields import with_fields
from docspark.operators.ocr import layout_of_pages, layout_summary
from docspark.operators.payload import merge_entities, payload_columns
from docspark.operators.small import is_small
from docspark.sources.messages import upload_hint
from docspark.sources.partitions import ARRIVED, only

TEXT_NOT_FOUND = "text_not_found"
_TABLES = ("texts", "blocks", "entities", "key_phrases", "pages", "entity_answers", "key_phrase_answers")

Grouping = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DocumentTables:
    """Tables the readers and language services fill, keyed by doc_id.

    texts:        doc_id, text, and the ``arrival`` columns that order its versions
    blocks:       cleaned word or line rows, in ``block_order``
    entities:     doc_id, pos, Text, Type, Score
    key_phrases:  doc_id, pos, Text, Score

    Readers and services also give whole pages and answers. These are cut to what a
    document keeps where they stand, without a row per word or entity:

    pages:             doc_id, order, n, blocks, of ``ocr.word_pages`` or ``ocr.line_pages``
    entity_answers:    doc_id, response: array of (Text, Type, Score)
    key_phrase_answers: doc_id, response: array of (Text, Score)

    A table may be partitioned by the day its document ``arrived``
    (``partitions.write_arrivals``).
    """

    texts: DataFrame
    blocks: DataFrame | None = None
    block_order: tuple[str, ...] = ("page", "pos")
    entities: DataFrame | None = None
    key_phrases: DataFrame | None = None
    arrival: tuple[str, ...] = ()
    pages: DataFrame | None = None
    entity_answers: DataFrame | None = None
    key_phrase_answers: DataFrame | None = None

    def restricted(self, events: DataFrame) -> DocumentTables:
        """The tables cut to the documents of some events.

        Where the events know the day their document arrived, only the partitions of
        these days are read. Ids that are few are broadcast, and nothing else is grouped.
        Against many ids every row would be shuffled, so only texts are cut here: of the
        other tables ``documents`` first takes what a document keeps, in the tasks that
        read them, and its joins drop the documents that no event names.
        """
        keys = events.select("doc_id").distinct()
        few = is_small(keys)

        def cut(name: str) -> DataFrame | None:
            table = getattr(self, name)
            if table is None:
                return None
            if ARRIVED in table.columns and ARRIVED in events.columns:
                table = only(table, ARRIVED, events).drop(ARRIVED)
            if few:
                return table.join(F.broadcast(keys), "doc_id", "left_semi")
            if name == "texts":
                return table.join(keys, "doc_id", "left_semi")
            return table.filter(F.col("doc_id").isNotNull())

        return replace(self, **{name: cut(name) for name in _TABLES})


def documents(tables: DocumentTables) -> DataFrame:
    """One row per document with text, layout and enrichment.

    Of a text that was written more than once the last one counts; without
    ``arrival`` columns, the last in the order of texts.
    All inputs are grouped by doc_id and stay partitioned by it, so these joins
    add no shuffle of their own.
    """
    given = tables.texts.withColumn("text", F.coalesce("text", F.lit("")))
    newest = [F.col(name).desc() for name in (*tables.arrival, "text")]
    texts = keyed.latest_rows(given, ["doc_id"], newest).select("doc_id", "text")
    entities, key_phrases = tables.entities, tables.key_phrases
    docs = enriched(
        texts,
        _one(entities, grouped_entities, tables.entity_answers, answered_entities),
        _one(key_phrases, grouped_key_phrases, tables.key_phrase_answers, answered_key_phrases),
    )
    if tables.blocks is None and tables.pages is None:
        empty = f"array<{schemas.LAYOUT_BLOCK.simpleString()}>"
        return docs.withColumns(
            {"line_count": F.lit(0).cast("bigint"), "layout_lines": F.lit(None).cast(empty)}
        )
    order = list(tables.block_order)
    layout = _one(tables.blocks, lambda rows: layout_summary(rows, order), tables.pages, layout_of_pages)
    return docs.join(layout, "doc_id", "left")


def _one(rows: DataFrame | None, of_rows: Grouping, whole: DataFrame | None, of_whole: Grouping) -> DataFrame | None:
    """One row per document, from whole pages or answers where they are given."""
    if whole is not None:
        return of_whole(whole)
    return None if rows is None else of_rows(rows)


def process(events: DataFrame, docs: DataFrame, backend: str | None = "tesseract") -> DataFrame:
    """Processed rows of valid upload events.

    Keeps the columns of the events; their type hint moves to ``upload_type``.
    Rows whose document has no text carry a ``reason``. Documents have one row
    each, so the join grows nothing, and an id that many events name is split
    by the adaptive skew join, as nothing after it needs the partitioning.
    """
    uploads = events.withColumnRenamed("doc_type", "upload_type").withColumn(
        "hint", upload_hint(F.col("upload_type"))
    )
    found = docs.withColumn("_found", F.lit(True))
    joined = uploads.join(found, "doc_id", "left")
    rows = with_fields(with_doc_type(joined))
    merged = merge_entities(
        F.col("fields"), F.col("entities"), F.col("person"), F.col("entity_organization")
    )
    kept = [name for name in uploads.columns if name not in ("doc_id", "hint")]
    sections = payload_columns(backend)
    return rows.withColumn("fields", merged).select(
        "doc_id",
        "doc_type",
        "fields",
        "confidence",
        *(expression.alias(name) for name, expression in sections.items()),
        *kept,
        F.when(F.col("_found").isNull(), TEXT_NOT_FOUND).alias("reason"),
    )
