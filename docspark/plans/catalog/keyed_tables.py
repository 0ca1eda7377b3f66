"""Upload messages, dead letters, processed and manifest tables, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import feedback as fb
from docspark.operators import tables
from docspark.plans import corpora
from docspark.plans.catalog.registry import query
from docspark.sources import files, messages, store

_DECODED = f"""{corpora.with_tables("upload_values")}, decoded AS (
  SELECT seq, value, CASE WHEN ok THEN value->>'doc_id' END AS doc_id,
    CASE WHEN ok THEN value->>'file_path' END AS file_path,
    CASE WHEN ok THEN coalesce(nullif(value->>'doc_type', ''), 'unknown') ELSE 'unknown' END
      AS doc_type,
    CASE WHEN NOT ok THEN 'invalid_json_object'
      WHEN value->>'doc_id' IS NULL THEN 'missing_doc_id'
      WHEN value->>'file_path' IS NULL THEN 'missing_file_path' END AS reason
  FROM (SELECT *, CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END AS ok
    FROM upload_values WHERE value IS NOT NULL AND value <> ''))"""


@query(f"{_DECODED} SELECT seq, doc_id, file_path, doc_type FROM decoded WHERE reason IS NULL")
def upload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = messages.decode_uploads(corpora.upload_values(spark, sf_dir))
    return messages.valid(decoded).select("seq", "doc_id", "file_path", "doc_type")


@query(f"{_DECODED} SELECT seq, value, reason FROM decoded WHERE reason IS NOT NULL")
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = messages.decode_uploads(corpora.upload_values(spark, sf_dir))
    return messages.dead_letters(decoded).select("seq", "value", "reason")


# A file table: what a scan of the raw folder reports, some uploads missing.
_FILES = """SELECT CASE WHEN doc_id % 3 = 0 THEN 's3://doc-store/raw/plain-'
      ELSE 'file:/raw/plain-' END || CAST(doc_id AS STRING) ||
    CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png?v=1.2' WHEN 2 THEN '' ELSE '.Tiff' END
      AS path,
    CAST(length(text) AS BIGINT) AS length FROM documents WHERE doc_id % 10 <> 9"""


@query(
    f"""{_DECODED}, files AS ({_FILES}) SELECT seq, doc_id, length,
      CASE WHEN length IS NULL THEN 'file_not_found' END AS reason
      FROM decoded LEFT JOIN files ON replace(path, 'file:/', 'file:///') = file_path
      WHERE reason IS NULL"""
)
def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = messages.decode_uploads(corpora.upload_values(spark, sf_dir))
    corpora.read(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    scanned = spark.sql(_FILES.replace("FROM documents", "FROM _documents"))
    joined = files.with_files(messages.valid(decoded), scanned)
    return joined.select("seq", "doc_id", "length", "reason")


@query(
    """SELECT user_id, event_type, value, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 1000 DESC,
        event_id % 1000 DESC) AS rn FROM events) WHERE rn = 1"""
)
def processed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = corpora.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        "event_type",
        "value",
        "event_id",
        F.floor(F.col("event_id") / F.lit(1000)).alias("batch_id"),
        (F.col("event_id") % 1000).alias("seq"),
    )
    latest = tables.latest_processed(versions, ["batch_id", "seq"])
    return latest.select(F.col("doc_id").alias("user_id"), "event_type", "value", "event_id")


_MANIFEST_LOG = """SELECT 'u' || CAST(event_id % 997 AS STRING) AS doc_id,
    '/raw/' || CAST(event_id AS STRING) AS file_path, event_type AS doc_type, status,
    CAST(ts AS STRING) AS ts,
    CASE WHEN status = 'processed' THEN '/out/' || CAST(event_id AS STRING) END AS processed_uri
  FROM (SELECT *, 'queued' AS status FROM events
    UNION ALL SELECT *, 'processed' AS status FROM events
      WHERE event_type IN ('purchase', 'click'))"""


@query(
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
      ORDER BY CAST(status = 'processed' AS INT) DESC, ts DESC) AS rn FROM ({_MANIFEST_LOG}))
      WHERE rn = 1"""
)
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpora.read(spark, sf_dir, "events").createOrReplaceTempView("_events")
    return tables.manifest_status(spark.sql(_MANIFEST_LOG.replace("FROM events", "FROM _events")))


# The log after every queued row was written once more, a day later.
_REPLAYED = f"""SELECT * FROM ({_MANIFEST_LOG}) UNION ALL
  SELECT doc_id, file_path, doc_type, status,
    CAST(CAST(substr(ts, 1, 4) AS INT) + 1 AS STRING) || substr(ts, 5) AS ts, processed_uri
  FROM ({_MANIFEST_LOG}) WHERE status = 'queued'"""


@query(
    f"""SELECT doc_id, max(status) AS status, max(processed_uri) FILTER (WHERE ts = newest) AS processed_uri
      FROM (SELECT doc_id, CASE WHEN bool_or(status = 'processed') OVER (PARTITION BY doc_id)
          THEN 'processed' ELSE 'queued' END AS status, processed_uri, ts,
        max(CASE WHEN status = 'processed' THEN ts END) OVER (PARTITION BY doc_id) AS newest
        FROM ({_REPLAYED})) GROUP BY doc_id"""
)
def manifest_after_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing batch that is run again takes nothing back."""
    corpora.read(spark, sf_dir, "events").createOrReplaceTempView("_events")
    log = spark.sql(_REPLAYED.replace("FROM events", "FROM _events"))
    return tables.manifest_status(log).select("doc_id", "status", "processed_uri")


@query(
    f"""{_DECODED}, files AS ({_FILES}) SELECT seq, doc_id, max(length) AS length,
      CASE WHEN max(length) IS NULL THEN 'file_not_found' END AS reason
      FROM decoded LEFT JOIN files ON replace(path, 'file:/', 'file:///') = file_path
      WHERE reason IS NULL GROUP BY seq, doc_id"""
)
def files_landed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that was landed three times leaves an event one event."""
    decoded = messages.decode_uploads(corpora.upload_values(spark, sf_dir))
    corpora.read(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    scanned = spark.sql(_FILES.replace("FROM documents", "FROM _documents"))
    shorter = scanned.withColumn("length", F.floor(F.col("length") / 2))
    landed = scanned.unionByName(scanned).unionByName(shorter)
    return files.with_files(messages.valid(decoded), landed).select("seq", "doc_id", "length", "reason")


@query(
    f"""{corpora.with_tables("feedback")} SELECT event_id, doc_id, field, predicted, actual, ts
      FROM feedback"""
)
def feedback_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every second one comes again, some with an older stamp and value."""
    events = corpora.feedback(spark, sf_dir)
    again = events.filter(F.col("event_id").cast("bigint") % 2 == 0)
    older = again.filter("ts IS NOT NULL").withColumns({"ts": F.lit("1970"), "actual": F.lit("old")})
    return store.latest_feedback(events.unionByName(again).unionByName(older))


@query(
    f"""{corpora.with_tables("mixed")}, done AS (SELECT 'plain-' || CAST(user_id AS STRING) AS doc_id,
      '/out/' || CAST(max(event_id) AS STRING) AS processed_uri FROM events GROUP BY 1)
      SELECT doc_id, kind, processed_uri,
        CASE WHEN processed_uri IS NOT NULL THEN 'processed' ELSE 'queued' END AS status
      FROM mixed LEFT JOIN done USING (doc_id)"""
)
def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = (
        corpora.read(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("plain-"), F.col("user_id").cast("string")).alias("doc_id"))
        .agg(F.concat(F.lit("/out/"), F.max("event_id").cast("string")).alias("processed_uri"))
    )
    uploads = corpora.mixed(spark, sf_dir).select("doc_id", "kind")
    return tables.status_of_uploads(uploads, done)


_FEEDBACK = corpora.with_tables("feedback")
OVERRIDES = """SELECT doc_id, trim(lower(max(actual)), ' ') AS override FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(ts, '') DESC, event_id DESC)
      AS rn FROM feedback WHERE field = 'doc_type' AND actual <> '') WHERE rn = 1 GROUP BY doc_id"""


@query(f"{_FEEDBACK} {OVERRIDES}")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.latest_overrides(corpora.feedback(spark, sf_dir))


@query(
    f"""{_FEEDBACK} SELECT doc_id, field, predicted, actual FROM feedback
      ORDER BY coalesce(ts, ''), event_id LIMIT 1000"""
)
def feedback_oldest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.oldest_first(corpora.feedback(spark, sf_dir), 1000)


@query(
    f"""{_FEEDBACK} SELECT event_id, doc_id, field, predicted, actual,
      row_number() OVER (ORDER BY coalesce(ts, ''), event_id) AS position FROM feedback"""
)
def feedback_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = fb.numbered_oldest_first(corpora.feedback(spark, sf_dir))
    return numbered.select("event_id", "doc_id", "field", "predicted", "actual", "position")


@query(f"{_FEEDBACK} SELECT event_id, doc_id, field FROM feedback WHERE actual IS NULL")
def feedback_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    incomplete = fb.incomplete(corpora.feedback(spark, sf_dir))
    return incomplete.select("event_id", "doc_id", "field")
