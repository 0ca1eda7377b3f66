"""Result payload: fields merged with entities, optional sections, JSON text."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import patterns as P
from docspark.functions import pyjson
from docspark.functions.text import null_if_empty

_OWN_KEYS = {
    "resume": ("name", "email", "phone", "skills"),
    "invoice": ("invoice_number", "total", "vendor_email"),
    "kyc": ("date_of_birth", "document_id"),
}


def merge_entities(
    fields: Column, entities: Column, person: Column, organization: Column
) -> Column:
    """Fields with the first person, the first organization and the entities.

    Without entities the fields stay as they are.
    """
    merged = (
        fields.withField("name", F.coalesce(null_if_empty(fields["name"]), person, fields["name"]))
        .withField(
            "organization",
            F.coalesce(null_if_empty(fields["organization"]), organization, fields["organization"]),
        )
        .withField("ml_entities", F.slice(entities, 1, P.MAX_FIELD_ENTITIES))
    )
    return F.when(F.size(entities) > 0, merged).otherwise(fields)


def payload_columns(backend: str | None) -> dict[str, Column]:
    """``ocr``, ``ml`` and ``layout`` sections from the joined columns.

    ``ml`` is there exactly when enrichment was tried for the row, ``layout``
    when the document has at least one block.
    """
    ocr_type = schemas.PROCESSED["ocr"].dataType
    return {
        "ocr": F.struct(F.lit(backend).alias("backend")) if backend else F.lit(None).cast(ocr_type),
        "ml": F.when(
            F.col("enriched"),
            F.struct(
                F.slice("entities", 1, P.MAX_ENTITIES).alias("entities"),
                F.slice("key_phrases", 1, P.MAX_KEY_PHRASES).alias("key_phrases"),
            ),
        ),
        "layout": F.when(
            F.col("line_count") > 0,
            F.struct(
                F.col("line_count"),
                F.slice("layout_lines", 1, P.MAX_LAYOUT_LINES).alias("lines"),
            ),
        ),
    }


def fields_json(doc_type: Column, fields: Column) -> Column:
    """JSON text of ``fields`` with the keys its document type has.

    A type's own keys are always printed, null or not; what the entities add
    to other types is printed when it is there.
    """
    types = {field.name: field.dataType for field in schemas.FIELDS.fields}

    def member(name: str, shown: Column) -> tuple[str, Column]:
        return name, F.when(shown, pyjson.dumps(fields[name], types[name]))

    own = [
        member(name, doc_type == owner) for owner, names in _OWN_KEYS.items() for name in names
    ]
    return pyjson.members(
        *own,
        member("raw_preview", ~doc_type.isin(*_OWN_KEYS)),
        member("name", (doc_type != "resume") & fields["name"].isNotNull()),
        member("organization", fields["organization"].isNotNull()),
        member("ml_entities", fields["ml_entities"].isNotNull()),
    )


def _layout_json(layout: Column) -> Column:
    def block(item: Column) -> Column:
        as_word = F.struct(*(item[f.name].alias(f.name) for f in schemas.WORD_BLOCK.fields))
        as_line = F.struct(*(item[f.name].alias(f.name) for f in schemas.LINE_BLOCK.fields))
        return F.when(
            item["type"].isNull(), pyjson.dumps(as_word, schemas.WORD_BLOCK)
        ).otherwise(pyjson.dumps(as_line, schemas.LINE_BLOCK))

    lines = F.array_join(F.transform(layout["lines"], block), ", ")
    return F.when(
        layout.isNotNull(),
        pyjson.members(
            ("line_count", layout["line_count"].cast("string")),
            ("lines", F.concat(F.lit("["), lines, F.lit("]"))),
        ),
    )


@cache
def payload_json(*extra: str) -> Column:
    """JSON text of a processed row; absent sections have no key.

    ``extra`` names string columns printed after the sections. The expression
    is large and refers to columns by name, so it is built once and not for
    every micro-batch.
    """
    types = {field.name: field.dataType for field in schemas.PROCESSED.fields}

    def section(name: str) -> tuple[str, Column]:
        value = F.col(name)
        return name, F.when(value.isNotNull(), pyjson.dumps(value, types[name]))

    return pyjson.members(
        ("doc_id", pyjson.dumps(F.col("doc_id"), types["doc_id"])),
        ("doc_type", pyjson.dumps(F.col("doc_type"), types["doc_type"])),
        ("fields", fields_json(F.col("doc_type"), F.col("fields"))),
        ("confidence", pyjson.float_text(F.col("confidence"))),
        section("ocr"),
        section("ml"),
        ("layout", _layout_json(F.col("layout"))),
        *((name, pyjson.quote(F.col(name))) for name in extra),
    )
