"""Typing and field extraction over documents of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import patterns as P
from docspark.functions.text import non_blank_lines, truncate_utf8
from docspark.operators import doctype
from docspark.operators import fields as X
from docspark.operators.doctype import with_doc_type
from docspark.operators.fields import with_fields
from docspark.operators.payload import fields_json
from docspark.operators.small import evened
from docspark.plans import corpora
from docspark.plans.catalog import sqltext as Q
from docspark.plans.catalog import sqlvalues as V
from docspark.plans.catalog.registry import query

_MIXED = corpora.with_tables("mixed")
_TYPED = f"{_MIXED}, typed AS ({Q.TYPED})"
FIELD_TABLES = f"{_TYPED}, fields AS ({Q.FIELDS})"


def extracted(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Typed documents of every kind with their fields; ``even`` if the parts of the files are not kept."""
    docs = corpora.mixed(spark, sf_dir)
    return with_fields(with_doc_type(evened(docs) if even else docs))


@query(
    f"""{_TYPED} SELECT doc_type, count(*) AS documents,
      round(avg(confidence), 6) AS mean_confidence FROM typed GROUP BY doc_type"""
)
def doc_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = with_doc_type(corpora.mixed(spark, sf_dir))
    return typed.groupBy("doc_type").agg(
        F.count("*").alias("documents"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query(
    f"""{_MIXED} SELECT doc_id, {Q.score("resume")} AS score_resume,
      {Q.score("invoice")} AS score_invoice, {Q.score("kyc")} AS score_kyc FROM mixed"""
)
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = corpora.mixed(spark, sf_dir).select(
        "doc_id", doctype.keyword_scores(F.col("text")).alias("s")
    )
    return scored.select("doc_id", *(F.col(f"s.{t}").alias(f"score_{t}") for t in P.DOC_TYPES))


@query(f"{_TYPED} SELECT doc_id, inferred AS doc_type, confidence FROM typed")
def doc_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = with_doc_type(corpora.mixed(spark, sf_dir), hint=None)
    return typed.select("doc_id", "doc_type", "confidence")


@query(f"{_TYPED} SELECT doc_id, hint, doc_type, confidence FROM typed")
def doc_type_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = with_doc_type(corpora.mixed(spark, sf_dir))
    return typed.select("doc_id", "hint", "doc_type", "confidence")


@query(f"{_MIXED} SELECT doc_id, {Q.EMAIL} AS email FROM mixed")
def email_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.mixed(spark, sf_dir).select("doc_id", X.email(F.col("text")).alias("email"))


@query(
    f"""{_MIXED} SELECT doc_id, len(p) AS phones, {Q.joined("p")} AS phone FROM (
      SELECT doc_id, {Q.PHONES} AS p FROM (
        SELECT doc_id, {Q.all_matches(V.PHONE)} AS ph FROM mixed))"""
)
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpora.mixed(spark, sf_dir).select("doc_id", X.phones(F.col("text")).alias("p"))
    return found.select(
        "doc_id",
        F.size("p").cast("bigint").alias("phones"),
        F.array_join("p", "|").alias("phone"),
    )


@query(
    f"""{_MIXED} SELECT doc_id, len(lines) AS lines, lines[1] AS first_line,
      md5({Q.joined("lines")}) AS lines_md5 FROM (SELECT doc_id, {Q.LINES} AS lines FROM mixed)"""
)
def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpora.mixed(spark, sf_dir).select(
        "doc_id", non_blank_lines(F.col("text")).alias("_lines")
    )
    return found.select(
        "doc_id",
        F.size("_lines").cast("bigint").alias("lines"),
        F.get("_lines", 0).alias("first_line"),
        F.md5(F.array_join("_lines", "|")).alias("lines_md5"),
    )


@query(f"{_MIXED} SELECT doc_id, left(text, {V.MAX_PREVIEW_CHARS}) AS raw_preview FROM mixed")
def raw_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.mixed(spark, sf_dir).select(
        "doc_id", X.raw_preview(F.col("text")).alias("raw_preview")
    )


@query(
    f"""{FIELD_TABLES} SELECT doc_id, name, email, {Q.joined("phone")} AS phone,
      {Q.joined("skills")} AS skills FROM fields WHERE doc_type = 'resume'"""
)
def resume_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        extracted(spark, sf_dir)
        .filter("doc_type = 'resume'")
        .select(
            "doc_id",
            "fields.name",
            "fields.email",
            F.array_join("fields.phone", "|").alias("phone"),
            F.array_join("fields.skills", "|").alias("skills"),
        )
    )


@query(
    f"""{FIELD_TABLES} SELECT doc_id, invoice_number, total, vendor_email FROM fields
      WHERE doc_type = 'invoice'"""
)
def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        extracted(spark, sf_dir)
        .filter("doc_type = 'invoice'")
        .select("doc_id", "fields.invoice_number", "fields.total", "fields.vendor_email")
    )


@query(f"{FIELD_TABLES} SELECT doc_id, date_of_birth, document_id FROM fields WHERE doc_type = 'kyc'")
def kyc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        extracted(spark, sf_dir)
        .filter("doc_type = 'kyc'")
        .select("doc_id", "fields.date_of_birth", "fields.document_id")
    )


@query(f"{FIELD_TABLES} SELECT doc_id, doc_type, confidence, {Q.json_fields()} AS fields FROM fields")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select(
        "doc_id",
        "doc_type",
        "confidence",
        fields_json(F.col("doc_type"), F.col("fields")).alias("fields"),
    )


_CUT = V.MAX_ENRICH_BYTES


def _continues(at: int) -> str:
    return f"substr(h, {2 * at - 1}, 1) IN ('8', '9', 'A', 'B')"


def sample_sql(source: str) -> str:
    """The text of a table cut to the size of an enrichment request."""
    return f"""SELECT doc_id, decode(unhex(left(h, 2 * CASE
        WHEN NOT {_continues(_CUT + 1)} THEN {_CUT} WHEN NOT {_continues(_CUT)} THEN {_CUT - 1}
        WHEN NOT {_continues(_CUT - 1)} THEN {_CUT - 2} ELSE {_CUT - 3} END))) AS sample
      FROM (SELECT doc_id, hex(encode(text)) AS h FROM {source})"""


@query(
    f"""SELECT doc_id, length(sample) AS chars, strlen(sample) AS bytes, md5(sample) AS sample_md5
    FROM ({sample_sql("documents")})"""
)
def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = corpora.read(spark, sf_dir, "documents").select(
        "doc_id", truncate_utf8(F.col("text")).alias("sample")
    )
    return cut.select(
        "doc_id",
        F.length("sample").cast("bigint").alias("chars"),
        F.octet_length("sample").cast("bigint").alias("bytes"),
        F.md5("sample").alias("sample_md5"),
    )
