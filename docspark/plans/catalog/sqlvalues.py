"""Values of the checking SQL, stated apart from those of the engine.

Patterns are in the plain spelling, with the character classes of the checking
engine, which know ASCII white space and digits only. The given tables hold no row
where that matters.
"""

# --- fixed values ----------------------------------------------------------
RESUME_KEYWORDS = ("curriculum", "vitae", "resume", "experience", "education", "skills", "linkedin")
INVOICE_KEYWORDS = ("invoice", "bill to", "amount due", "total", "tax id", "vat", "payment terms")
KYC_KEYWORDS = ("passport", "national id", "date of birth", "government", "kyc", "identity")

PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
LINE_BREAK = r"\r\n|[\n\v\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?\d[\d\s\-().]{8,}\d"
SKILL = r"[A-Za-z][A-Za-z0-9+#.\s]{1,24}"
INVOICE_NUMBER = r"(?i)(?:invoice\s*#|inv\s*#|no\.?)\s*[:\s]*([A-Z0-9\-]+)"
AMOUNT = r"(?:\$|USD|EUR|£)\s*[\d,]+\.?\d*"
BIRTH_DATE = r"(?i)(?:dob|date of birth|born)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
DOCUMENT_ID = r"(?i)(?:document|id|passport)\s*#?\s*[:\s]*([A-Z0-9]{6,})"
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"

MAX_PHONES = 5
MAX_SKILL_LINES = 8
MAX_SKILLS = 20
MAX_PREVIEW_CHARS = 500
MAX_ENTITIES = 50
MAX_KEY_PHRASES = 30
MAX_LAYOUT_LINES = 40
MAX_FIELD_ENTITIES = 25
MAX_ENRICH_BYTES = 4500

UNREADABLE_IMAGE = "[unreadable image]"
NO_PDF_RENDERER = "[pdf2image not installed]"
# ---------------------------------------------------------------------------
