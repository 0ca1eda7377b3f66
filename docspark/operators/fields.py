"""Field extraction per document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import patterns as P
from docspark.functions.text import first_line, first_match, non_blank_lines, once, strip


def email(text: Column) -> Column:
    return first_match(text, P.EMAIL_SEARCH)


def phones(text: Column) -> Column:
    """First distinct phone-like runs in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(P.PHONE), F.lit(0))
    return F.slice(F.array_distinct(found), 1, P.MAX_PHONES)


def resume_skills(text: Column) -> Column:
    """Skill phrases of the block opened by the first line naming skills.

    Null when there are none. The heading itself counts as a phrase and
    phrases may repeat.
    """

    def block(lines: Column) -> Column:
        names_skills = F.transform(lines, lambda line: F.contains(F.lower(line), F.lit("skill")))
        start = F.array_position(names_skills, True).cast("int")
        return F.array_join(F.slice(lines, start, P.MAX_SKILL_LINES), "\n")

    found = F.regexp_extract_all(once(non_blank_lines(text), block), F.lit(P.SKILL), F.lit(0))
    phrases = F.filter(F.transform(found, strip), lambda phrase: F.length(phrase) > 2)
    kept = once(F.slice(phrases, 1, P.MAX_SKILLS), lambda a: F.when(F.size(a) > 0, a))
    return F.when(F.contains(F.lower(text), F.lit("skills")), kept)


def invoice_number(text: Column) -> Column:
    return first_match(text, P.INVOICE_NUMBER, 1)


def invoice_total(text: Column) -> Column:
    """Last amount in the text, as it is written."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(P.AMOUNT), F.lit(0)), F.lit(-1))


def birth_date(text: Column) -> Column:
    return first_match(text, P.BIRTH_DATE, 1)


def document_id(text: Column) -> Column:
    return first_match(text, P.DOCUMENT_ID, 1)


def raw_preview(text: Column) -> Column:
    return F.substring(text, 1, P.MAX_PREVIEW_CHARS)


def field_columns(doc_type: Column, text: Column) -> dict[str, Column]:
    """Every extracted field, null outside the branch of its document type.

    ``CASE`` is lazy, so a row pays only for the patterns of its own type.
    The type is matched as it is spelled: 'Resume' is no 'resume'.
    """
    by_type = {
        "resume": {
            "name": first_line(text),
            "email": email(text),
            "phone": phones(text),
            "skills": resume_skills(text),
        },
        "invoice": {
            "invoice_number": invoice_number(text),
            "total": invoice_total(text),
            "vendor_email": email(text),
        },
        "kyc": {
            "date_of_birth": birth_date(text),
            "document_id": document_id(text),
        },
    }
    columns = {
        name: F.when(doc_type == value, expression)
        for value, fields in by_type.items()
        for name, expression in fields.items()
    }
    columns["raw_preview"] = F.when(~doc_type.isin(*by_type), raw_preview(text))
    return columns


def with_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the ``fields`` struct for the row's ``doc_type``."""
    columns = field_columns(F.col("doc_type"), F.col(text))
    return df.withColumn(
        "fields",
        F.struct(
            *(
                columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
                for field in schemas.FIELDS.fields
            )
        ),
    )
