"""Text expressions with the meaning of Python's string methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import patterns as P


def strip(text: Column) -> Column:
    """``str.strip()``: Spark's own ``trim`` removes U+0020 only."""
    return F.btrim(text, F.lit(P.PY_SPACE))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match that is not empty, null if there is none.

    ``regexp_substr`` and ``nullif`` write the match out twice, and inside a
    ``CASE`` it would be searched for twice.
    """
    return once(F.regexp_extract(text, pattern, group), lambda found: F.nullif(found, F.lit("")))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text.

    Stops at the first other character, where stripping reads the whole text.
    """
    return ~F.coalesce(text.rlike(f"[^{P.SPACE}]"), F.lit(False))


def non_blank_lines(text: Column) -> Column:
    """Stripped lines that are not empty, in order."""
    lines = F.transform(F.split(text, P.LINE_BREAK), strip)
    return F.filter(lines, lambda line: line != "")


def first_line(text: Column) -> Column:
    """First of ``non_blank_lines`` without building the array.

    Every line boundary is white space, so the first character that is not
    white space opens the first non-blank line. Null when there is none.
    """
    tail = first_match(text, rf"[^{P.SPACE}][^{P.LINE_BREAK_CHARS}]*")
    return F.rtrim(tail, F.lit(P.PY_SPACE))


def truncate_utf8(text: Column, max_bytes: int = P.MAX_ENRICH_BYTES) -> Column:
    """Longest prefix of at most ``max_bytes`` UTF-8 bytes.

    A character cut in two is dropped: when the byte after the cut continues a
    character, the cut moves back to that character's first byte, which is one
    to three places away.
    """
    data = text.cast("binary")

    def byte(at: int) -> Column:
        return F.hex(F.substring(data, at, 1))

    def starts_character(at: int) -> Column:
        return byte(at) >= F.lit("C0")

    whole = ~byte(max_bytes + 1).between("80", "BF")
    kept = (
        F.when(whole, max_bytes)
        .when(starts_character(max_bytes), max_bytes - 1)
        .when(starts_character(max_bytes - 1), max_bytes - 2)
        .otherwise(max_bytes - 3)
    )
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.substring(data, F.lit(1), kept).cast("string")
    )
