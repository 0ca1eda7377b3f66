"""Keyword lists, character sets and extraction patterns.

Patterns are written with explicit character sets instead of ``\\s``, ``\\d``
and Unicode case folding, so that they mean the same in Java regular
expressions as in the Python ones whose results they have to equal:

* white space is the set of characters for which ``str.isspace`` holds;
* a digit is any Unicode decimal digit (``Nd``);
* ignoring case, ``i``, ``k`` and ``s`` also match their four non-ASCII
  partners (U+0130, U+0131, U+212A, U+017F).
"""

# --- fixed values ----------------------------------------------------------

RESUME_KEYWORDS = (
    "curriculum",
    "vitae",
    "resume",
    "experience",
    "education",
    "skills",
    "linkedin",
)
INVOICE_KEYWORDS = (
    "invoice",
    "bill to",
    "amount due",
    "total",
    "tax id",
    "vat",
    "payment terms",
)
KYC_KEYWORDS = (
    "passport",
    "national id",
    "date of birth",
    "government",
    "kyc",
    "identity",
)

# Characters removed by str.strip().
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The same set as the inside of a character class.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Line boundaries of str.splitlines().
LINE_BREAK_CHARS = r"\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE_BREAK = rf"\r\n|[{LINE_BREAK_CHARS}]"

DIGIT = r"\p{Nd}"
ALNUM_ANY_CASE = "A-Z0-9İıſK"
I = "[i\u0130\u0131]"  # noqa: E741
S = "[s\u017f]"

EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = rf"\+?{DIGIT}[{DIGIT}{SPACE}\-().]{{8,}}{DIGIT}"
SKILL = rf"[A-Za-z][A-Za-z0-9+#.{SPACE}]{{1,24}}"
INVOICE_NUMBER = (
    rf"(?i)(?:{I}nvo{I}ce[{SPACE}]*#|{I}nv[{SPACE}]*#|no\.?)"
    rf"[:{SPACE}]*([{ALNUM_ANY_CASE}\-]+)"
)
AMOUNT = rf"(?:\$|USD|EUR|£)[{SPACE}]*[{DIGIT},]+\.?{DIGIT}*"
BIRTH_DATE = (
    rf"(?i)(?:dob|date of b{I}rth|born)[:{SPACE}]+"
    rf"({DIGIT}{{1,2}}[/-]{DIGIT}{{1,2}}[/-]{DIGIT}{{2,4}})"
)
DOCUMENT_ID = (
    rf"(?i)(?:document|{I}d|pa{S}{S}port)(?:[{SPACE}]*#)?"
    rf"[:{SPACE}]*([{ALNUM_ANY_CASE}]{{6,}})"
)
# A token of two or more word characters (letters, numbers, underscore).
TOKEN = r"[\p{L}\p{N}_]{2,}"

MAX_PHONES = 5
MAX_SKILL_LINES = 8
MAX_SKILLS = 20
MAX_PREVIEW_CHARS = 500
MAX_ENTITIES = 50
MAX_KEY_PHRASES = 30
MAX_LAYOUT_LINES = 40
MAX_FIELD_ENTITIES = 25
MAX_ENRICH_BYTES = 4500

DOC_TYPES = ("resume", "invoice", "kyc")  # also the order that decides ties
UNKNOWN = "unknown"

UNREADABLE_IMAGE = "[unreadable image]"
NO_PDF_RENDERER = "[pdf2image not installed]"
PDF_FAILED = "[pdf conversion failed: %s]"

# --- search forms ----------------------------------------------------------

# The first e-mail always starts where a run of local-part characters starts,
# and '@' is no such character. Saying so keeps the search linear on long
# unbroken runs (base64, hashes), where the plain form is quadratic.
EMAIL_SEARCH = r"(?<![a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
