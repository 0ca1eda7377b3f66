"""Fragments of the checking SQL."""

from __future__ import annotations

from docspark.plans.catalog import sqlvalues as V


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = quoted(V.PY_SPACE)


def stripped(text: str) -> str:
    return f"trim({text}, {SPACES})"


def score(doc_type: str, text: str = "text") -> str:
    words = {"resume": V.RESUME_KEYWORDS, "invoice": V.INVOICE_KEYWORDS, "kyc": V.KYC_KEYWORDS}
    return " + ".join(f"CAST(contains(lower({text}), {quoted(w)}) AS INT)" for w in words[doc_type])


TYPED = f"""SELECT *, CASE WHEN hint IS NULL OR hint IN ('', 'unknown') THEN inferred ELSE hint END
    AS doc_type FROM (
  SELECT *, CASE WHEN best = 0 THEN 'unknown' WHEN r = best THEN 'resume' WHEN i = best THEN 'invoice'
      ELSE 'kyc' END AS inferred,
    CASE WHEN best = 0 THEN 0.3::DOUBLE
      ELSE round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.15::DOUBLE * best), 4) END AS confidence
  FROM (SELECT *, greatest(r, i, k) AS best FROM (
    SELECT doc_id, kind, text, hint, {score("resume")} AS r, {score("invoice")} AS i,
      {score("kyc")} AS k FROM mixed)))"""

LINES = (
    f"list_filter(list_transform(string_split_regex(text, {quoted(V.LINE_BREAK)}), "
    f"lambda x: {stripped('x')}), lambda x: x <> '')"
)


def first_match(pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract(text, {quoted(pattern)}, {group}), '')"


def all_matches(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)})"


EMAIL = first_match(V.EMAIL)
# First-seen distinct: keep a match whose first position is its own.
PHONES = (
    "list_transform(list_filter(list_transform(range(1, len(ph) + 1), "
    "lambda n: CASE WHEN list_position(ph, ph[n]) = n THEN ph[n] END), lambda x: x IS NOT NULL), lambda x: x)"
    f"[1:{V.MAX_PHONES}]"
)
SKILL_START = "list_position(list_transform(lines, lambda x: contains(lower(x), 'skill')), true)"
SKILLS = (
    "list_filter(list_transform(regexp_extract_all(array_to_string("
    f"lines[{SKILL_START}:{SKILL_START} + {V.MAX_SKILL_LINES - 1}], chr(10)), {quoted(V.SKILL)}), "
    f"lambda x: {stripped('x')}), lambda x: length(x) > 2)[1:{V.MAX_SKILLS}]"
)

# Every field of every document; `phone` and `skills` are lists.
FIELDS = f"""SELECT doc_id, kind, doc_type, confidence, inferred, text,
    CASE WHEN doc_type = 'resume' THEN lines[1] END AS name,
    CASE WHEN doc_type = 'resume' THEN em END AS email,
    CASE WHEN doc_type = 'resume' THEN {PHONES} END AS phone,
    CASE WHEN doc_type = 'resume' AND contains(lower(text), 'skills') AND len({SKILLS}) > 0
      THEN {SKILLS} END AS skills,
    CASE WHEN doc_type = 'invoice' THEN {first_match(V.INVOICE_NUMBER, 1)} END AS invoice_number,
    CASE WHEN doc_type = 'invoice' THEN {all_matches(V.AMOUNT)}[-1] END AS total,
    CASE WHEN doc_type = 'invoice' THEN em END AS vendor_email,
    CASE WHEN doc_type = 'kyc' THEN {first_match(V.BIRTH_DATE, 1)} END AS date_of_birth,
    CASE WHEN doc_type = 'kyc' THEN {first_match(V.DOCUMENT_ID, 1)} END AS document_id,
    CASE WHEN doc_type NOT IN ('resume', 'invoice', 'kyc')
      THEN left(text, {V.MAX_PREVIEW_CHARS}) END AS raw_preview
  FROM (SELECT *, {LINES} AS lines, {EMAIL} AS em, {all_matches(V.PHONE)} AS ph FROM typed)"""


def joined(items: str, separator: str = "|") -> str:
    return f"array_to_string({items}, {quoted(separator)})"


def json_string(text: str) -> str:
    """JSON string with ASCII escapes, 'null' for null."""
    code = "unicode(c)"
    low = f"({code} - 65536)"
    escaped = (
        "CASE c WHEN chr(34) THEN '\\\"' WHEN chr(92) THEN '\\\\' WHEN chr(10) THEN '\\n' "
        "WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' WHEN chr(8) THEN '\\b' "
        "WHEN chr(12) THEN '\\f' ELSE "
        f"CASE WHEN {code} BETWEEN 32 AND 126 THEN c "
        f"WHEN {code} < 65536 THEN '\\u' || format('{{:04x}}', {code}) "
        f"ELSE '\\u' || format('{{:04x}}', 55296 + {low} // 1024) || "
        f"'\\u' || format('{{:04x}}', 56320 + {low} % 1024) END END"
    )
    characters = f"regexp_extract_all({text}, '(?s).')"
    body = f"array_to_string(list_transform({characters}, lambda c: {escaped}), '')"
    return f"CASE WHEN {text} IS NULL THEN 'null' ELSE chr(34) || {body} || chr(34) END"


def json_strings(items: str) -> str:
    one = json_string("s")
    return (
        f"CASE WHEN {items} IS NULL THEN 'null' ELSE "
        f"'[' || array_to_string(list_transform({items}, lambda s: {one}), ', ') || ']' END"
    )


def json_fields(entities: bool = False) -> str:
    """JSON text of the fields of a FIELDS row, by document type."""

    def text(name: str) -> str:
        return f"'\"{name}\": ' || " + json_string(name)

    def strings(name: str) -> str:
        return f"'\"{name}\": ' || " + json_strings(name)

    own = f"""CASE doc_type
      WHEN 'resume' THEN concat_ws(', ', {text("name")}, {text("email")}, {strings("phone")},
        {strings("skills")})
      WHEN 'invoice' THEN concat_ws(', ', {text("invoice_number")}, {text("total")},
        {text("vendor_email")})
      WHEN 'kyc' THEN concat_ws(', ', {text("date_of_birth")}, {text("document_id")})
      ELSE {text("raw_preview")} END"""
    if not entities:
        return f"'{{' || {own} || '}}'"
    added = f"""CASE WHEN doc_type <> 'resume' AND name IS NOT NULL THEN ', ' || {text("name")}
        ELSE '' END ||
      CASE WHEN organization IS NOT NULL THEN ', ' || {text("organization")} ELSE '' END ||
      CASE WHEN ml_entities IS NOT NULL THEN ', "ml_entities": ' || ml_entities ELSE '' END"""
    return f"'{{' || {own} || {added} || '}}'"
