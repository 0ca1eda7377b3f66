"""Input tables of the registered queries, derived from the given tables.

The given tables hold no invoices, resumes, OCR words or corrections, so they
are rendered from whole tables row by row. The rendering expressions are
written in the SQL that Spark and the checking engine share, and are used for
both, so that both start from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.text import once

WORDS_PER_PAGE = 200
BLOCKS_PER_RESULT = 50

_HINT = """CASE key % 11 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Resume' WHEN 2 THEN 'contract'
  WHEN 3 THEN '' WHEN 4 THEN 'invoice' WHEN 5 THEN 'kyc' WHEN 6 THEN 'resume' END"""

_INVOICE = """'INVOICE' || chr(10) ||
  CASE o_orderkey % 4 WHEN 0 THEN 'Invoice #: INV-' WHEN 1 THEN 'Inv # '
    WHEN 2 THEN 'Invoice No. A-' ELSE 'Order ' END || CAST(o_orderkey AS STRING) ||
  chr(10) || 'Bill to: ' || c_name ||
  chr(10) || 'Subtotal $' || CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS STRING) ||
  CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'Payment terms: net 30, VAT included' ELSE '' END ||
  CASE WHEN o_orderkey % 3 = 0 THEN chr(13) || chr(10) || 'Mail ap.' ||
    CAST(o_custkey AS STRING) || '@vendor.example.com.' ELSE '' END ||
  chr(10) || CASE o_orderkey % 3 WHEN 0 THEN 'Total USD ' WHEN 1 THEN 'Total EUR'
    ELSE 'Total £  ' END || CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS STRING)"""

_RESUME = """CASE WHEN c_custkey % 6 = 0 THEN chr(10) || '  ' ELSE '' END ||
  replace(c_name, '#', ' ') || '  ' || chr(10) ||
  'c' || CAST(c_custkey AS STRING) || '@mail.example.com' || chr(10) ||
  '+1 (415) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ||
  CASE WHEN c_custkey % 2 = 0 THEN ' or 0' || lpad(CAST(c_custkey AS STRING), 9, '0') ELSE '' END ||
  CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '+1 (415) 555-' ||
    lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE '' END ||
  chr(10) || chr(10) || 'Experience' || chr(10) || '  ' || n_name || ' branch, 10 years' ||
  chr(13) || chr(10) || CASE WHEN c_custkey % 7 = 0 THEN 'Tools' ELSE 'Skills: Python, C++' END ||
  chr(10) || c_mktsegment || ', SQL' || chr(9) || chr(10) || 'Node.js; R; Go' || chr(10) ||
  CASE WHEN c_custkey % 4 = 0 THEN 'Education: MSc' || chr(10) || 'LinkedIn' ELSE 'Vitae' END"""

_KYC = """CASE WHEN s_suppkey % 3 = 0 THEN 'Government form' ELSE 'KYC record' END || chr(10) ||
  'Name: ' || s_name || chr(10) ||
  CASE s_suppkey % 4 WHEN 0 THEN 'Passport # P' WHEN 1 THEN 'Passport No: X'
    WHEN 2 THEN 'Document: D' ELSE 'National ID #: N' END ||
  lpad(CAST(s_suppkey AS STRING), 7, '0') || chr(10) ||
  CASE s_suppkey % 3 WHEN 0 THEN 'DOB: ' WHEN 1 THEN 'Date of birth: ' ELSE 'Born ' END ||
  CAST(s_suppkey % 28 + 1 AS STRING) || '/' || CAST(s_suppkey % 12 + 1 AS STRING) || '-' ||
  CAST(1950 + s_suppkey % 50 AS STRING)"""

# kind: (tables, join conditions, key column, text)
_RENDERED = {
    "invoice": (("orders", "customer"), "o_custkey = c_custkey", "o_orderkey", _INVOICE),
    "resume": (("customer", "nation"), "c_nationkey = n_nationkey", "c_custkey", _RESUME),
    "kyc": (("supplier",), None, "s_suppkey", _KYC),
    "plain": (("documents",), None, "doc_id", "text"),
}

FEEDBACK = (
    "CAST(event_id AS STRING) AS event_id",
    "CASE WHEN event_id % 2 = 0 THEN 'plain-' ELSE 'kyc-' END || CAST(user_id AS STRING) AS doc_id",
    "CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'doc_type' ELSE 'name' END AS field",
    "CASE WHEN event_id % 3 = 0 THEN 'unknown' END AS predicted",
    """CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN ' '
      WHEN event_id % 23 = 0 THEN NULL ELSE ' ' || upper(event_type) || ' ' END AS actual""",
    "CASE WHEN event_id % 31 <> 0 THEN substr(CAST(ts AS STRING), 1, 13) || ':00' END AS ts",
)

UPLOAD_VALUE = """CASE doc_id % 16
  WHEN 0 THEN '{"file_path": "/raw/x.png", "doc_type": "invoice"}'
  WHEN 1 THEN '{"doc_id": "plain-' || CAST(doc_id AS STRING) || '", "doc_type": "kyc"}'
  WHEN 2 THEN '{"doc_id": "plain-' || CAST(doc_id AS STRING) || '", "file_path": '
  WHEN 3 THEN '["plain-' || CAST(doc_id AS STRING) || '"]'
  WHEN 4 THEN ''
  WHEN 5 THEN NULL
  WHEN 6 THEN '{"doc_id": ' || CAST(doc_id AS STRING) || ', "file_path": "/raw/y.JPG"}'
  WHEN 7 THEN '{"doc_id": "plain-' || CAST(doc_id AS STRING) ||
    '", "file_path": null, "doc_type": "kyc"}'
  ELSE '{"doc_id": "plain-' || CAST(doc_id AS STRING) || '", "file_path": "' ||
    CASE WHEN doc_id % 3 = 0 THEN 's3://doc-store/raw/plain-' ELSE 'file:///raw/plain-' END ||
    CAST(doc_id AS STRING) ||
    CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png?v=1.2' WHEN 2 THEN '' ELSE '.Tiff' END ||
    '"' || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ', "doc_type": ""'
      WHEN 2 THEN ', "doc_type": null' WHEN 3 THEN ', "doc_type": "unknown"'
      ELSE ', "doc_type": "invoice"' END || '}'
  END AS value"""

_WORD_SPLIT = r"[\t\n\f\r ]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, in the parts its files have."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rendered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    tables, condition, key, text = _RENDERED[kind]
    frames = [read(spark, sf_dir, table) for table in tables]
    source = reduce(lambda left, right: left.join(right, F.expr(condition)), frames)
    rows = source.selectExpr(
        f"'{kind}' AS kind", f"CAST({key} AS BIGINT) AS key", f"{text} AS text"
    )
    return rows.selectExpr(
        f"'{kind}-' || CAST(key AS STRING) AS doc_id", "kind", "text", f"{_HINT} AS hint"
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every kind: doc_id, kind, text, hint."""
    return reduce(DataFrame.unionByName, (_rendered(spark, sf_dir, k) for k in _RENDERED))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("plain-"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.col("doc_id").alias("key"),
        "text",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*FEEDBACK)


def upload_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the upload topic: value and arrival order."""
    return read(spark, sf_dir, "documents").selectExpr(UPLOAD_VALUE, "doc_id AS seq")


def _given(spark: SparkSession, sf_dir: str, docs: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The plain documents, or some of them with further columns, and the names of these."""
    if docs is None:
        return plain(spark, sf_dir), []
    return docs, [name for name in docs.columns if name not in ("doc_id", "key", "text")]


def _pages(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """One row per page: doc_id, key, page, words. A page's row carries its own words only."""
    docs, others = _given(spark, sf_dir, docs)

    def cut(words: Column) -> Column:
        last = F.floor((F.size(words) - 1) / F.lit(WORDS_PER_PAGE)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda page: F.struct(
                page.alias("page"),
                F.slice(words, page * WORDS_PER_PAGE + 1, F.lit(WORDS_PER_PAGE)).alias("words"),
            ),
        )

    pages = once(F.split("text", _WORD_SPLIT), cut)
    return docs.select("doc_id", "key", *others, F.inline(pages))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page", F.array_join("words", " ").alias("text"))


def ocr_word_arrays(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """One row per page with the parallel arrays of a word table; further columns of ``docs`` are kept."""
    pages = _pages(spark, sf_dir, docs)
    others = [name for name in pages.columns if name not in ("doc_id", "key", "page", "words")]
    seed = F.col("key") + F.col("page") * 11

    def per_word(expression):
        return F.transform("words", expression)

    def conf(word, at):
        value = at * 37 + seed
        return F.when(value % 13 == 5, F.lit("n/a")).otherwise(
            F.concat((value % 120 - 10).cast("string"), F.lit(".5"))
        )

    return pages.select(
        "doc_id",
        *others,
        "page",
        F.col("words").alias("text"),
        per_word(conf).alias("conf"),
        per_word(lambda w, i: i % 10 * 60).alias("left"),
        per_word(lambda w, i: F.floor(i / F.lit(10)) * 20).alias("top"),
        per_word(lambda w, i: F.length(w) * 9).alias("width"),
        per_word(lambda w, i: 12 + i % 3).alias("height"),
    )


def ocr_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line recognition answers: one row per result page with its blocks."""

    def block(line, at):
        present = lambda every: at % every != every - 1
        kind = (at + F.col("key")) % 5
        return F.struct(
            F.when(kind == 3, "WORD").when(kind == 4, "PAGE").otherwise("LINE").alias("BlockType"),
            F.when(present(17), line).alias("Text"),
            F.when(present(19), (at % 10).cast("double") + 90.25).alias("Confidence"),
            F.when(present(7), F.floor(at / F.lit(40)).cast("int") + 1).alias("Page"),
            F.when(
                present(11),
                F.struct(
                    ((at % 4).cast("double") * 0.25).alias("Left"),
                    ((at % 8).cast("double") * 0.125).alias("Top"),
                    F.lit(0.25).alias("Width"),
                    F.lit(0.125).alias("Height"),
                ),
            ).alias("bbox"),
        )

    blocks = F.transform(F.split("text", "\n"), block)
    docs = plain(spark, sf_dir).select("doc_id", blocks.alias("blocks"))
    last = F.floor((F.size("blocks") - 1) / F.lit(BLOCKS_PER_RESULT)).cast("int")
    return docs.select(
        "doc_id", "blocks", F.explode(F.sequence(F.lit(0), last)).alias("result_no")
    ).withColumn(
        "blocks",
        F.slice("blocks", F.col("result_no") * BLOCKS_PER_RESULT + 1, F.lit(BLOCKS_PER_RESULT)),
    )


def entity_responses(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Entity service answers: one row per document with an array; further columns of ``docs`` are kept."""
    docs, others = _given(spark, sf_dir, docs)

    def entity(token, at):
        kind = (at + F.col("key")) % 4
        return F.struct(
            F.when(at % 23 == 22, "").otherwise(token).alias("Text"),
            F.when(kind == 0, "PERSON")
            .when(kind == 1, "LOCATION")
            .when(kind == 2, "DATE")
            .otherwise("ORGANIZATION")
            .alias("Type"),
            F.when(at % 29 != 28, (at % 1000).cast("double") / 1000.0).alias("Score"),
        )

    tokens = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    return docs.select("doc_id", *others, F.transform(tokens, entity).alias("response"))


def key_phrase_responses(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs, others = _given(spark, sf_dir, docs)

    def phrase(token, at):
        return F.struct(
            token.alias("Text"),
            F.when(at % 31 != 30, (at % 100).cast("double") / 100.0).alias("Score"),
        )

    tokens = F.regexp_extract_all("text", F.lit("[a-z]+ [a-z]+"), F.lit(0))
    return docs.select("doc_id", *others, F.transform(tokens, phrase).alias("response"))


def exploded(responses: DataFrame) -> DataFrame:
    others = [name for name in responses.columns if name not in ("doc_id", "response")]
    return responses.select("doc_id", *others, F.posexplode("response").alias("pos", "_r")).select(
        "doc_id", *others, "pos", "_r.*"
    )


# --- the same tables for the checking engine ---------------------------------


def _rendered_sql(kind: str) -> str:
    tables, condition, key, text = _RENDERED[kind]
    source = tables[0] + "".join(f" JOIN {table} ON {condition}" for table in tables[1:])
    return (
        f"SELECT '{kind}-' || CAST(key AS STRING) AS doc_id, '{kind}' AS kind, text, "
        f"{_HINT} AS hint FROM (SELECT CAST({key} AS BIGINT) AS key, {text} AS text FROM {source})"
    )


SQL = {
    "mixed": " UNION ALL ".join(_rendered_sql(kind) for kind in _RENDERED),
    "plain": "SELECT 'plain-' || CAST(doc_id AS STRING) AS doc_id, doc_id AS key, text FROM documents",
    "feedback": f"SELECT {', '.join(FEEDBACK)} FROM events",
    "upload_values": f"SELECT {UPLOAD_VALUE}, doc_id AS seq FROM documents",
    "words": rf"""SELECT doc_id, key, g, w FROM (
        SELECT doc_id, key, unnest(ws) AS w, unnest(range(len(ws))) AS g FROM (
          SELECT doc_id, key, string_split_regex(text, '[\t\n\f\r ]+') AS ws FROM plain))""",
    "ocr_words": f"""SELECT doc_id, page, pos, w AS text,
        CASE WHEN v % 13 = 5 THEN 'n/a' ELSE CAST(v % 120 - 10 AS VARCHAR) || '.5' END AS conf,
        pos % 10 * 60 AS "left", pos // 10 * 20 AS top, length(w) * 9 AS width,
        12 + pos % 3 AS height
      FROM (SELECT *, pos * 37 + key + page * 11 AS v FROM (
        SELECT doc_id, key, g // {WORDS_PER_PAGE} AS page, g % {WORDS_PER_PAGE} AS pos, w
        FROM words))""",
    "ocr_pages": f"""SELECT doc_id, g // {WORDS_PER_PAGE} AS page,
        string_agg(w, ' ' ORDER BY g) AS text FROM words GROUP BY ALL""",
    "ocr_blocks": f"""SELECT doc_id, i // {BLOCKS_PER_RESULT} AS result_no,
        i % {BLOCKS_PER_RESULT} AS pos,
        CASE (i + key) % 5 WHEN 3 THEN 'WORD' WHEN 4 THEN 'PAGE' ELSE 'LINE' END AS block_type,
        CASE WHEN i % 17 <> 16 THEN line END AS text,
        CASE WHEN i % 19 <> 18 THEN CAST(i % 10 AS DOUBLE) + 90.25 END AS confidence,
        CASE WHEN i % 7 <> 6 THEN i // 40 + 1 END AS page,
        CASE WHEN i % 11 <> 10 THEN CAST(i % 4 AS DOUBLE) * 0.25 END AS box_left,
        CASE WHEN i % 11 <> 10 THEN CAST(i % 8 AS DOUBLE) * 0.125 END AS box_top
      FROM (SELECT doc_id, key, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (
        SELECT doc_id, key, string_split(text, chr(10)) AS ls FROM plain))""",
    "entity_rows": """SELECT doc_id, i AS pos,
        CASE WHEN i % 23 = 22 THEN '' ELSE token END AS text,
        CASE (i + key) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'DATE'
          ELSE 'ORGANIZATION' END AS type,
        CASE WHEN i % 29 <> 28 THEN CAST(i % 1000 AS DOUBLE) / 1000.0 END AS score
      FROM (SELECT doc_id, key, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM (
        SELECT doc_id, key, regexp_extract_all(text, '[A-Z][a-z]+') AS ts FROM plain))""",
    "key_phrase_rows": """SELECT doc_id, i AS pos, token AS text,
        CASE WHEN i % 31 <> 30 THEN CAST(i % 100 AS DOUBLE) / 100.0 END AS score
      FROM (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '[a-z]+ [a-z]+') AS ts FROM plain))""",
}

_NEEDS = {
    "words": ("plain",),
    "ocr_words": ("plain", "words"),
    "ocr_pages": ("plain", "words"),
    "ocr_blocks": ("plain",),
    "entity_rows": ("plain",),
    "key_phrase_rows": ("plain",),
}


def with_tables(*names: str) -> str:
    """``WITH`` clause that defines the named derived tables."""
    ordered: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered)
