"""JSON text as Python's ``json.dumps`` prints it.

``to_json`` differs in ways that change tokens and bytes: no blank after
separators, non-ASCII text unescaped, Java spelling of small doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.text import once

_SHORT_ESCAPES = (
    ("\\", "\\\\"),
    ('"', '\\"'),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("\b", "\\b"),
    ("\f", "\\f"),
)


def _escape_unit(piece: Column) -> Column:
    """A run of printable ASCII as it is, one other character as ``\\uXXXX``."""
    code_units = F.lower(F.hex(F.encode(piece, "UTF-16BE")))
    return F.when(~piece.rlike("[^ -~]"), piece).otherwise(
        F.regexp_replace(code_units, "(.{4})", r"\\u$1")
    )


def quote(text: Column) -> Column:
    """Quoted and escaped string, null for null."""
    short = text
    for plain, escaped in _SHORT_ESCAPES:
        short = F.replace(short, F.lit(plain), F.lit(escaped))

    def ascii_only(value: Column) -> Column:
        pieces = F.regexp_extract_all(value, F.lit("([ -~]+|[^ -~])"), F.lit(1))
        whole = F.array_join(F.transform(pieces, _escape_unit), "")
        return F.when(~value.rlike("[^ -~]"), value).otherwise(whole)

    body = F.when(~text.rlike(r'[^ -~]|["\\]'), text).otherwise(once(short, ascii_only))
    return F.concat(F.lit('"'), body, F.lit('"'))


def float_text(value: Column) -> Column:
    """``repr`` of a double below 1e7 (scores, confidences, box geometry)."""
    java = value.cast("string")
    digits = F.replace(F.regexp_extract(java, r"^-?(\d\.\d+)E", 1), F.lit("."), F.lit(""))
    digits = F.regexp_replace(digits, "^(.)0$", "$1")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    exponent = F.regexp_extract(java, r"E-(\d+)$", 1)
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?\d\.\d+)E", 1), r"\.0$", "")
    return (
        F.when(~F.contains(java, F.lit("E-")), java)
        .when(exponent == "4", F.concat(sign, F.lit("0.000"), digits))
        .otherwise(F.concat(mantissa, F.lit("e-"), F.lpad(exponent, 2, "0")))
    )


def dumps(value: Column, data_type: T.DataType) -> Column:
    """JSON text of a column of the given type; null becomes ``null``."""
    if isinstance(data_type, T.StructType):
        text = members(
            *(
                (field.name, dumps(value.getField(field.name), field.dataType))
                for field in data_type.fields
            )
        )
        text = F.when(value.isNotNull(), text)
    elif isinstance(data_type, T.ArrayType):
        items = F.transform(value, lambda item: dumps(item, data_type.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(data_type, T.StringType):
        text = quote(value)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = float_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def members(*named: tuple[str, Column]) -> Column:
    """JSON object of already printed members; a null member has no key."""
    pairs = [F.concat(F.lit(f'"{name}": '), text) for name, text in named]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
