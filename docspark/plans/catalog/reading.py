"""Recognised words, lines and pages; upload paths; entities; payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import paths
from docspark.functions import pyjson
from docspark.operators import entities as E
from docspark.operators import ocr
from docspark.operators.payload import payload_json
from docspark.operators.small import stored
from docspark.plans import corpora
from docspark.plans.catalog import sqltext as Q
from docspark.plans.catalog import sqlvalues as V
from docspark.plans.catalog.documents import FIELD_TABLES, sample_sql
from docspark.plans.catalog.registry import query
from docspark.plans.process import DocumentTables, documents, process
from docspark.sources.partitions import dealt_texts

_WORDS = f"""{corpora.with_tables("ocr_words")}, clean AS (
  SELECT doc_id, page, pos, {Q.stripped("text")} AS text, "left", top, width, height,
    TRY_CAST(conf AS DOUBLE) / 100.0 AS confidence FROM ocr_words
  WHERE {Q.stripped("text")} <> '' AND coalesce(TRY_CAST(conf AS DOUBLE), -1) >= 0)"""
_LINES = f"""{corpora.with_tables("ocr_blocks")}, lines AS (
  SELECT doc_id, result_no, pos, 'LINE' AS type, coalesce(text, '') AS text,
    coalesce(confidence, 0) / 100.0 AS confidence, coalesce(page, 1) AS page, box_left, box_top
  FROM ocr_blocks WHERE block_type = 'LINE')"""


def words(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return ocr.clean_words(ocr.words_from_arrays(corpora.ocr_word_arrays(spark, sf_dir, docs)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.clean_lines(ocr.blocks_from_results(corpora.ocr_result_pages(spark, sf_dir)))


@query(
    f"""{_WORDS} SELECT doc_id, CAST(page AS INT) AS page, CAST(pos AS INT) AS pos, text,
      CAST("left" AS INT) AS "left", CAST(top AS INT) AS top, CAST(width AS INT) AS width,
      CAST(height AS INT) AS height, confidence FROM clean"""
)
def ocr_words_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir)


@query(
    f"""{_LINES} SELECT doc_id, CAST(result_no AS INT) AS result_no, CAST(pos AS INT) AS pos, type,
      text, confidence, CAST(page AS INT) AS page, box_left, box_top FROM lines"""
)
def ocr_lines_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        *("doc_id", "result_no", "pos", "type", "text", "confidence", "page"),
        F.col("bbox.Left").alias("box_left"),
        F.col("bbox.Top").alias("box_top"),
    )


@query(
    f"""{corpora.with_tables("ocr_pages")} SELECT doc_id, count(*) AS pages,
      md5(string_agg({Q.stripped("text")}, chr(10) || chr(10) ORDER BY page)) AS text_md5
      FROM ocr_pages GROUP BY doc_id"""
)
def ocr_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpora.ocr_pages(spark, sf_dir)
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return (
        ocr.page_text(pages)
        .join(counts, "doc_id")
        .select("doc_id", "pages", F.md5("text").alias("text_md5"))
    )


@query(
    f"""{_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY result_no, pos) AS text
      FROM lines GROUP BY doc_id"""
)
def ocr_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.line_text(lines(spark, sf_dir))


@query(
    f"""{_WORDS} SELECT doc_id, CAST(page AS INT) AS page, text, confidence,
      row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS box_no FROM clean"""
)
def ocr_layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = ocr.boxes_of_pages(corpora.ocr_word_arrays(spark, sf_dir))
    return boxes.select("doc_id", "page", "text", "confidence", "box_no")


def _summary(blocks: DataFrame, order: list[str]) -> DataFrame:
    return ocr.layout_summary(blocks, order).select(
        "doc_id",
        "line_count",
        F.array_join(F.transform("layout_lines", lambda b: b["text"]), "|").alias("first_texts"),
        F.round(
            F.aggregate("layout_lines", F.lit(0.0), lambda a, b: a + b["confidence"]), 6
        ).alias("confidence_sum"),
    )


def _summary_sql(tables: str, name: str, order: str) -> str:
    return f"""{tables} SELECT doc_id, max(n) AS line_count,
      string_agg(text, '|' ORDER BY rn) FILTER (WHERE rn <= {V.MAX_LAYOUT_LINES}) AS first_texts,
      round(sum(confidence ORDER BY rn) FILTER (WHERE rn <= {V.MAX_LAYOUT_LINES}), 6)
        AS confidence_sum
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM {name})
      GROUP BY doc_id"""


@query(_summary_sql(_WORDS, "clean", "page, pos"))
def layout_summary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_texts(corpora.plain(spark, sf_dir), "doc_id", F.xxhash64("text"))
    return _summary(words(spark, sf_dir, docs), ["page", "pos"])


@query(_summary_sql(_LINES, "lines", "result_no, pos"))
def layout_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(lines(spark, sf_dir), ["result_no", "pos"])


_STATUS = """CASE doc_id % 5 WHEN 0 THEN 'unreadable_image' WHEN 1 THEN 'no_pdf_renderer'
  WHEN 2 THEN 'pdf_failed' ELSE 'ok' END"""


@query(
    f"""SELECT doc_id, CASE {_STATUS} WHEN 'unreadable_image' THEN '{V.UNREADABLE_IMAGE}'
      WHEN 'no_pdf_renderer' THEN '{V.NO_PDF_RENDERER}'
      WHEN 'pdf_failed' THEN '[pdf conversion failed: ' || source || ']' ELSE text END AS text
      FROM documents"""
)
def ocr_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.read(spark, sf_dir, "documents")
    text = ocr.text_or_sentinel(F.col("text"), F.expr(_STATUS), F.col("source"))
    return docs.select("doc_id", text.alias("text"))


# Upload paths: page addresses and rendered object and file paths.
_PATHS = """SELECT 'page-' || CAST(page_id AS STRING) AS id, url AS uri FROM pages
  UNION ALL
  SELECT 'doc-' || CAST(doc_id AS STRING) AS id,
    CASE doc_id % 3 WHEN 0 THEN 's3://store-' || source || '/raw/' || CAST(doc_id AS STRING)
      WHEN 1 THEN 'file:///data/raw/' || CAST(doc_id AS STRING)
      ELSE '/data/v1.2/' || CAST(doc_id AS STRING) END ||
    CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png?v=1.2' WHEN 2 THEN ''
      WHEN 3 THEN '.tar.Gz' WHEN 4 THEN '/.hidden' WHEN 5 THEN '.' ELSE '.Tiff' END AS uri
  FROM documents"""


def _extension_sql(path: str) -> str:
    name = f"string_split(rtrim({path}, '/'), '/')[-1]"
    dot = f"(length({name}) - position('.' IN reverse({name})) + 1)"
    return f"""CASE WHEN position('.' IN {name}) > 0 AND {dot} > 1 AND {dot} < length({name})
      THEN substr({name}, {dot}) END"""


_SUFFIX_SQL = f"coalesce(lower({_extension_sql("string_split(uri, '?')[1]")}), '.png')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpora.read(spark, sf_dir, "pages").createOrReplaceTempView("_pages")
    corpora.read(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql(
        _PATHS.replace("FROM pages", "FROM _pages").replace("FROM documents", "FROM _documents")
    )


@query(
    f"""SELECT id, {_SUFFIX_SQL} AS suffix,
      CASE WHEN {_SUFFIX_SQL} = '.pdf' THEN 'pdf_render' ELSE 'image' END AS default_route,
      CASE WHEN {_SUFFIX_SQL} = '.pdf' THEN 'pdf_render'
        WHEN starts_with(uri, 's3://') THEN 'textract_async' ELSE 'textract_sync' END
        AS textract_route,
      CASE WHEN starts_with(uri, 's3://') THEN 's3' ELSE 'local' END AS storage FROM ({_PATHS})"""
)
def upload_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.col("uri")
    return _paths(spark, sf_dir).select(
        "id",
        paths.suffix(uri).alias("suffix"),
        paths.ocr_route(uri, "tesseract").alias("default_route"),
        paths.ocr_route(uri, "textract").alias("textract_route"),
        paths.storage_kind(uri).alias("storage"),
    )


_REST_SQL = "CASE WHEN starts_with(uri, 's3://') THEN substr(uri, 6) ELSE uri END"


@query(
    f"""SELECT id, id || coalesce({_extension_sql("uri")}, '.bin') AS stored_name,
      string_split(rest, '/')[1] AS bucket,
      CASE WHEN contains(rest, '/') THEN substr(rest, position('/' IN rest) + 1) ELSE '' END AS key
      FROM (SELECT *, {_REST_SQL} AS rest FROM ({_PATHS}))"""
)
def storage_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.col("uri")
    return _paths(spark, sf_dir).select(
        "id",
        paths.stored_name(F.col("id"), uri).alias("stored_name"),
        paths.bucket(uri).alias("bucket"),
        paths.key(uri).alias("key"),
    )


# --- entities and payloads -----------------------------------------------------

_ENTITIES = corpora.with_tables("mixed", "entity_rows", "key_phrase_rows")
_SCORED = "round(coalesce(score, 0), 4)"


@query(
    f"""{corpora.with_tables("entity_rows")} SELECT doc_id, CAST(pos AS INT) AS pos, text, type,
      {_SCORED} AS score FROM entity_rows"""
)
def entities_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clean_entities(corpora.exploded(corpora.entity_responses(spark, sf_dir)))


@query(
    f"""{corpora.with_tables("key_phrase_rows")} SELECT doc_id, CAST(pos AS INT) AS pos, text,
      {_SCORED} AS score FROM key_phrase_rows"""
)
def key_phrases_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clean_key_phrases(corpora.exploded(corpora.key_phrase_responses(spark, sf_dir)))


@query(
    f"""{corpora.with_tables("entity_rows")} SELECT doc_id, len(e) AS entities,
      array_to_string(e, '|') AS entity FROM (
        SELECT doc_id, list(text || '/' || type || '/' || CAST({_SCORED} AS VARCHAR) ORDER BY pos)
          AS e FROM entity_rows GROUP BY doc_id)"""
)
def entity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpora.entity_responses(spark, sf_dir).select(
        "doc_id", E.entity_items(F.col("response")).alias("e")
    )
    as_text = F.transform("e", lambda e: F.concat_ws("/", e["text"], e["type"], e["score"].cast("string")))
    return items.filter(F.size("e") > 0).select(
        "doc_id",
        F.size("e").cast("bigint").alias("entities"),
        F.array_join(as_text, "|").alias("entity"),
    )


@query(
    f"""{corpora.with_tables("entity_rows")} SELECT doc_id, CAST(count(*) AS BIGINT) AS entities,
      string_agg(text, '|' ORDER BY pos) AS entity,
      max(person) AS person, max(organization) AS organization FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn,
          first_value(CASE WHEN type = 'PERSON' AND text <> '' THEN text END IGNORE NULLS) OVER w
            AS person,
          first_value(CASE WHEN type = 'ORGANIZATION' AND text <> '' THEN text END IGNORE NULLS)
            OVER w AS organization
        FROM entity_rows WINDOW w AS (PARTITION BY doc_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      WHERE rn <= {V.MAX_ENTITIES} GROUP BY doc_id"""
)
def entities_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = E.grouped_entities(corpora.exploded(corpora.entity_responses(spark, sf_dir)))
    return grouped.select(
        "doc_id",
        F.size("entities").cast("bigint").alias("entities"),
        F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("entity"),
        "person",
        F.col("entity_organization").alias("organization"),
    )


def tables(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DocumentTables:
    """Texts of every kind; pages of words, answers of entities and phrases of the plain ones."""
    return DocumentTables(
        texts=corpora.mixed(spark, sf_dir) if texts is None else texts,
        pages=ocr.word_pages(corpora.ocr_word_arrays(spark, sf_dir)),
        entity_answers=corpora.entity_responses(spark, sf_dir),
        key_phrase_answers=corpora.key_phrase_responses(spark, sf_dir),
    )


def upload_events(texts: DataFrame) -> DataFrame:
    return texts.select(
        "doc_id",
        F.concat(F.lit("/raw/"), F.col("doc_id")).alias("file_path"),
        F.coalesce(F.nullif("hint", F.lit("")), F.lit("unknown")).alias("doc_type"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed rows of all documents. The rendered texts are a stored table, read for events and texts."""
    texts = stored(corpora.mixed(spark, sf_dir))
    return process(upload_events(texts), documents(tables(spark, sf_dir, texts)))


_ENTITY_JSON = f"""'{{"text": ' || {Q.json_string("text")} || ', "type": ' ||
  {Q.json_string("type")} || ', "score": ' || CAST({_SCORED} AS VARCHAR) || '}}'"""
_PHRASE_JSON = f"""'{{"text": ' || {Q.json_string("text")} || ', "score": ' ||
  CAST({_SCORED} AS VARCHAR) || '}}'"""
_WORD_JSON = f"""'{{"page": ' || page || ', "text": ' || {Q.json_string("text")} || ', "left": ' ||
  "left" || ', "top": ' || top || ', "width": ' || width || ', "height": ' || height ||
  ', "confidence": ' || CAST(confidence AS VARCHAR) || '}}'"""

PAYLOAD_TABLES = f"""{FIELD_TABLES},
  plain AS ({corpora.SQL["plain"]}), words AS ({corpora.SQL["words"]}),
  ocr_words AS ({corpora.SQL["ocr_words"]}), clean AS ({_WORDS.split("clean AS (", 1)[1]},
  entity_rows AS ({corpora.SQL["entity_rows"]}),
  key_phrase_rows AS ({corpora.SQL["key_phrase_rows"]}),
  layouts AS (SELECT doc_id, max(n) AS line_count, string_agg({_WORD_JSON}, ', ' ORDER BY rn)
      FILTER (WHERE rn <= {V.MAX_LAYOUT_LINES}) AS first_lines
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n,
      row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS rn FROM clean) GROUP BY doc_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM entity_rows),
  ents AS (SELECT doc_id,
      string_agg({_ENTITY_JSON}, ', ' ORDER BY rn) FILTER (WHERE rn <= {V.MAX_ENTITIES}) AS e50,
      string_agg({_ENTITY_JSON}, ', ' ORDER BY rn) FILTER (WHERE rn <= {V.MAX_FIELD_ENTITIES})
        AS e25,
      first(text ORDER BY rn) FILTER (WHERE type = 'PERSON' AND text <> '') AS person,
      first(text ORDER BY rn) FILTER (WHERE type = 'ORGANIZATION' AND text <> '') AS org
    FROM ranked GROUP BY doc_id),
  phrases AS (SELECT doc_id, string_agg({_PHRASE_JSON}, ', ' ORDER BY rn) AS k30
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn
      FROM key_phrase_rows) WHERE rn <= {V.MAX_KEY_PHRASES} GROUP BY doc_id),
  merged AS (SELECT f.* EXCLUDE (name), {Q.stripped("f.text")} <> '' AS enriched,
      CASE WHEN {Q.stripped("f.text")} <> '' AND e50 IS NOT NULL
        THEN coalesce(nullif(f.name, ''), person, f.name) ELSE f.name END AS name,
      CASE WHEN {Q.stripped("f.text")} <> '' THEN org END AS organization,
      CASE WHEN {Q.stripped("f.text")} <> '' AND e50 IS NOT NULL THEN '[' || e25 || ']' END
        AS ml_entities, e50, k30, line_count, first_lines
    FROM fields f LEFT JOIN ents USING (doc_id) LEFT JOIN phrases USING (doc_id)
      LEFT JOIN layouts USING (doc_id))"""

PAYLOAD_JSON = f"""'{{"doc_id": "' || doc_id || '", "doc_type": ' || {Q.json_string("doc_type")} ||
  ', "fields": ' || {Q.json_fields(entities=True)} || ', "confidence": ' ||
  CAST(confidence AS VARCHAR) || ', "ocr": {{"backend": "tesseract"}}' ||
  CASE WHEN enriched THEN ', "ml": {{"entities": [' || coalesce(e50, '') ||
    '], "key_phrases": [' || coalesce(k30, '') || ']}}' ELSE '' END ||
  CASE WHEN line_count > 0 THEN ', "layout": {{"line_count": ' || line_count || ', "lines": [' ||
    first_lines || ']}}' ELSE '' END || '}}'"""


@query(f"{PAYLOAD_TABLES} SELECT doc_id, {PAYLOAD_JSON} AS payload FROM merged")
def result_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir)
    return rows.select("doc_id", payload_json().alias("payload"))


@query(
    f"""{PAYLOAD_TABLES} SELECT doc_id, doc_type, name, organization, ml_entities FROM merged
      WHERE ml_entities IS NOT NULL"""
)
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir).filter(F.col("fields.ml_entities").isNotNull())
    entities_type = schemas.FIELDS["ml_entities"].dataType
    return rows.select(
        "doc_id",
        "doc_type",
        "fields.name",
        "fields.organization",
        pyjson.dumps(F.col("fields.ml_entities"), entities_type).alias("ml_entities"),
    )


_WITH_TEXT = f"(SELECT * FROM mixed WHERE {Q.stripped('text')} <> '')"


@query(
    f"""{corpora.with_tables("mixed")} SELECT doc_id, md5(sample) AS sample_md5
      FROM ({sample_sql(_WITH_TEXT)})"""
)
def enrichment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = E.enrichment_requests(corpora.mixed(spark, sf_dir))
    return requests.select("doc_id", F.md5("sample").alias("sample_md5"))
