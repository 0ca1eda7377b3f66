"""Document typing by keyword scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import patterns as P
from docspark.functions.text import once

_KEYWORDS = {
    "resume": P.RESUME_KEYWORDS,
    "invoice": P.INVOICE_KEYWORDS,
    "kyc": P.KYC_KEYWORDS,
}


def keyword_scores(text: Column) -> Column:
    """Struct with, per type, how many of its keywords occur in the text.

    The text is lower-cased once. The count runs over a constant array: one
    small expression, where a sum of twenty terms is copied into every later
    projection and filter and outgrows the size of a compiled method.
    """

    def hits(lowered: Column, words: tuple[str, ...]) -> Column:
        keywords = F.array(*(F.lit(word) for word in words))
        return F.size(F.filter(keywords, lambda word: F.contains(lowered, word)))

    return once(
        F.lower(text),
        lambda lowered: F.struct(
            *(hits(lowered, _KEYWORDS[doc_type]).alias(doc_type) for doc_type in P.DOC_TYPES)
        ),
    )


def classification(text: Column) -> Column:
    """Struct of the inferred type and its confidence."""

    def classify(scores: Column) -> Column:
        best = F.greatest(*(scores[doc_type] for doc_type in P.DOC_TYPES))
        return once(
            best,
            lambda top: F.struct(
                F.when(top == 0, P.UNKNOWN)
                .when(scores["resume"] == top, "resume")
                .when(scores["invoice"] == top, "invoice")
                .otherwise("kyc")
                .alias("inferred"),
                F.when(top == 0, F.lit(0.3))
                .otherwise(F.round(F.least(F.lit(0.95), F.lit(0.4) + F.lit(0.15) * top), 4))
                .alias("confidence"),
            ),
        )

    return once(keyword_scores(text), classify)


def effective_type(hint: Column, inferred: Column) -> Column:
    """The hint unless it is null, empty or 'unknown', else the inferred type."""
    return F.when(F.coalesce(hint, F.lit("")).isin("", P.UNKNOWN), inferred).otherwise(hint)


def with_doc_type(df: DataFrame, text: str = "text", hint: str | None = "hint") -> DataFrame:
    """Adds ``inferred``, ``confidence`` (of the inferred type) and ``doc_type``."""
    typed = df.withColumn("_class", classification(F.col(text))).select("*", "_class.*")
    inferred = F.col("inferred")
    chosen = inferred if hint is None else effective_type(F.col(hint), inferred)
    return typed.withColumn("doc_type", chosen).drop("_class")
