"""Named entities and key phrases of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import patterns as P
from docspark.functions.text import is_blank, truncate_utf8
from docspark.operators import keyed


def score(value: Column) -> Column:
    return F.round(F.coalesce(value.try_cast("double"), F.lit(0.0)), 4)


def entity_items(response: Column) -> Column:
    """Entities of a response array of (Text, Type, Score)."""
    items = F.transform(
        response,
        lambda e: F.struct(
            e["Text"].alias("text"), e["Type"].alias("type"), score(e["Score"]).alias("score")
        ),
    )
    return F.coalesce(items, F.array().cast(_array_of(schemas.ENTITY)))


def key_phrase_items(response: Column) -> Column:
    """Key phrases of a response array of (Text, Score)."""
    items = F.transform(
        response,
        lambda k: F.struct(k["Text"].alias("text"), score(k["Score"]).alias("score")),
    )
    return F.coalesce(items, F.array().cast(_array_of(schemas.KEY_PHRASE)))


def _array_of(item) -> str:
    return f"array<{item.simpleString()}>"


def clean_entities(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "pos",
        F.col("Text").alias("text"),
        F.col("Type").alias("type"),
        score(F.col("Score")).alias("score"),
    )


def clean_key_phrases(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "pos", F.col("Text").alias("text"), score(F.col("Score")).alias("score")
    )


def enrichment_requests(docs: DataFrame) -> DataFrame:
    """What the language service is asked: text cut to its size, none if blank."""
    return docs.filter(~is_blank(F.col("text"))).select(
        "doc_id", truncate_utf8(F.col("text")).alias("sample")
    )


def grouped_entities(rows: DataFrame) -> DataFrame:
    """Per document: first entities, first person, first organization.

    The first person or organization may stand behind the entities kept.
    """
    entities = clean_entities(rows)
    item = F.struct("text", "type", "score")
    first = keyed.first_as_array(entities, "doc_id", ["pos"], P.MAX_ENTITIES, item, "entities")
    named = entities.filter(F.col("type").isin("PERSON", "ORGANIZATION") & (F.col("text") != ""))

    def first_of(kind: str) -> Column:
        wanted = F.col("type") == kind
        return F.min_by(F.when(wanted, F.col("text")), F.when(wanted, F.col("pos")))

    names = named.groupBy("doc_id").agg(
        first_of("PERSON").alias("person"),
        first_of("ORGANIZATION").alias("entity_organization"),
    )
    return first.join(names, "doc_id", "left")


def grouped_key_phrases(rows: DataFrame) -> DataFrame:
    item = F.struct("text", "score")
    return keyed.first_as_array(
        clean_key_phrases(rows), "doc_id", ["pos"], P.MAX_KEY_PHRASES, item, "key_phrases"
    )


def _names(entity: Column, kind: str) -> Column:
    return (entity["Type"] == kind) & (entity["Text"] != "")


def _deciding_entities(response: Column) -> Column:
    """The first entities of an answer, and all up to its first person and its first organization.

    An answer that lacks one of them stays whole. Answers that are cut so are ordered as
    whole ones: two that agree as far as one is cut are cut at the same place.
    """

    def upto(kind: str) -> Column:
        at = F.array_position(F.transform(response, lambda e: F.coalesce(_names(e, kind), F.lit(False))), True)
        return F.when(at > 0, at).otherwise(F.size(response))

    last = F.greatest(F.lit(P.MAX_ENTITIES), upto("PERSON"), upto("ORGANIZATION"))
    return F.slice(response, F.lit(1), last.cast("int"))


def answered_entities(responses: DataFrame) -> DataFrame:
    """``grouped_entities`` of whole answers (doc_id, response), without a row per entity.

    Of several answers for a document the greatest counts. Answers are cut before they
    are shuffled, to what decides the result.
    """
    cut = responses.select("doc_id", _deciding_entities(F.col("response")).alias("response"))
    answers = cut.groupBy("doc_id").agg(F.max("response").alias("response"))

    def first_of(kind: str) -> Column:
        return F.get(F.filter("response", lambda e: _names(e, kind)), 0)["Text"]

    return answers.filter(F.size("response") > 0).select(
        "doc_id",
        entity_items(F.slice("response", 1, P.MAX_ENTITIES)).alias("entities"),
        first_of("PERSON").alias("person"),
        first_of("ORGANIZATION").alias("entity_organization"),
    )


def answered_key_phrases(responses: DataFrame) -> DataFrame:
    """``grouped_key_phrases`` of whole answers (doc_id, response), cut before they are shuffled.

    The first phrases of the greatest answer are the greatest first phrases.
    """
    cut = responses.select("doc_id", F.slice("response", 1, P.MAX_KEY_PHRASES).alias("response"))
    answers = cut.groupBy("doc_id").agg(F.max("response").alias("response"))
    return answers.filter(F.size("response") > 0).select(
        "doc_id", key_phrase_items(F.slice("response", 1, P.MAX_KEY_PHRASES)).alias("key_phrases")
    )


def with_enrichment(
    docs: DataFrame, entities: DataFrame | None, key_phrases: DataFrame | None
) -> DataFrame:
    """Documents with their entity and key-phrase arrays, from a row per entity and phrase."""
    return enriched(
        docs,
        None if entities is None else grouped_entities(entities),
        None if key_phrases is None else grouped_key_phrases(key_phrases),
    )


def enriched(docs: DataFrame, entities: DataFrame | None, key_phrases: DataFrame | None) -> DataFrame:
    """Documents with the entity and key-phrase arrays of one row per document.

    ``enriched`` tells whether enrichment applies to the row: it does unless it
    is switched off (both inputs None) or the text is blank. Both arrays may
    then be empty.
    """
    enabled = entities is not None or key_phrases is not None
    out = docs
    if entities is not None:
        out = out.join(entities, "doc_id", "left")
    if key_phrases is not None:
        out = out.join(key_phrases, "doc_id", "left")
    out = out.withColumn("enriched", ~is_blank(F.col("text")) if enabled else F.lit(False))

    def array(name: str, schema) -> Column:
        empty = F.array().cast(_array_of(schema))
        if name not in out.columns:
            return empty
        return F.when(F.col("enriched"), F.coalesce(F.col(name), empty)).otherwise(empty)

    def text(name: str) -> Column:
        if name not in out.columns:
            return F.lit(None).cast("string")
        return F.when(F.col("enriched"), F.col(name))

    return out.withColumns(
        {
            "entities": array("entities", schemas.ENTITY),
            "key_phrases": array("key_phrases", schemas.KEY_PHRASE),
            "person": text("person"),
            "entity_organization": text("entity_organization"),
        }
    )
