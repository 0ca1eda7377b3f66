"""Small tables with everything that may be odd about a row."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

# Columns that operators make themselves, present in the input.
CLASHING = (
    "kept keep_id row component_id n_shingles shard slot size copies copy rate shuffle_key score predicted label "
    "n_words clean_text ids n_tokens _id _key _text _row _hash level position status held_out n_chars2 a.b"
).split()

LONG = " ".join(f"word{i % 7919} and{i % 31}" for i in range(120_000))
PLAIN = "The quick brown fox jumps over the lazy dog near the river bank every single morning of the year"

DOCUMENTS = [
    # doc_id, text, lang, source
    (1, PLAIN, "en", "src0"),
    (2, PLAIN, "en", "src0"),
    (2, PLAIN, "en", "src0"),  # a repeated row
    (3, PLAIN + " today", "en", "src1"),
    (3, "another text under the id of the row before it with some words more to read", "en", "src1"),
    (4, None, "en", "src0"),
    (5, "", None, "src0"),
    (6, " \t\n\r\x0b\x0c ", "en", None),
    (7, "one", None, None),
    (None, PLAIN, "en", "src1"),
    (None, None, None, None),
    (None, "a text without an id of its own that is read like any other text of this table", "en", "src2"),
    (8, LONG, "en", "src2"),
    (9, LONG + " end", "en", "src2"),
    (10, "T h e quick brown fox jumpsoverthe lazy dog near the river bank every single morning of the year", "en", "src9"),
    (11, "Zeile eins ist da\n" * 40 + "und eine andere Zeile am Ende mit noch mehr Worten darin", "de", "src3"),
    (12, "퟿ é漢😀 ١٢٣ ​ \xa0 it's we'll 'tis\n\n  x" * 3, "xx", "src3"),
    (-5, "negative id with a text that has rather more than ten words in it, to be kept", "en", "src0"),
    (13, "a" * 200_000, "en", "src0"),
]

PAGES = [
    (1, "http://a", "<html><body><article><h1>Title</h1><p>Some &amp; text.</p></article></body></html>"),
    (1, "http://a", "<html><body><article><h1>Title</h1><p>Some &amp; text.</p></article></body></html>"),
    (2, None, None),
    (None, "http://b", ""),
    (3, "http://c", "<p"),
    (4, "http://d", "plain text only"),
    (5, "http://e", "<nav>menu</nav>" * 1000),
    (6, "http://f", "<div>" * 50_000 + "<p>deep</p>"),
    (7, "http://g", "<script>never closed <p>x</p>"),
]

LABELS = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 1), (8, None, 0), (None, 1, 0), (11, 0, None), (99, 1, 0), (13, 0, 0)]

CONVERSATIONS = [
    (1, 0, "user", "hello there"),
    (1, 1, "assistant", "hi"),
    (1, 1, "assistant", "hi"),
    (1, 2, "user", None),
    (2, 0, "user", 'quotes " and \\ and \n lines'),
    (None, 0, "user", "no conversation"),
    (3, None, "user", "no turn"),
    (3, 1, None, "no role"),
    (4, 1, "assistant", "an answer to nothing"),
    (28, 0, "user", "broken"),
    (20, 4, "user", ""),
]


def _write(path: Path, names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> None:
    columns = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
    for extra in CLASHING:
        if extra not in columns:
            columns[extra] = pa.array([f"x{i}" for i in range(len(rows))], pa.string())
    pq.write_table(pa.table(columns), path)


def write(folder: Path, rows: bool = True) -> str:
    """Writes all tables to `folder`, without rows if `rows` is false."""
    folder.mkdir(parents=True, exist_ok=True)
    some = lambda r: r if rows else []
    text, whole = pa.string(), pa.int64()
    documents = [(*r, None if r[1] is None else len(r[1])) for r in DOCUMENTS]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    _write(folder / "documents.parquet", names, [whole, text, text, text, whole], some(documents))
    _write(folder / "pages.parquet", ["page_id", "url", "html"], [whole, text, text], some(PAGES))
    _write(folder / "labels.parquet", ["doc_id", "quality", "toxic"], [whole, whole, whole], some(LABELS))
    _write(
        folder / "conversations.parquet", ["conv_id", "turn", "role", "text"], [whole, whole, text, text], some(CONVERSATIONS)
    )
    return str(folder)
