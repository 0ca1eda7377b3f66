"""Landing, publication and object files: jobs run on given tables and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators.payload import fields_json
from docspark.operators.small import new_base
from docspark.plans import corpora, training
from docspark.plans.catalog.documents import FIELD_TABLES
from docspark.plans.catalog.keyed_tables import _DECODED, _FILES
from docspark.plans.catalog.registry import query
from docspark.plans.catalog.sqltext import json_fields
from docspark.plans.process import DocumentTables, documents, process
from docspark.sources import files, landed, messages, objects, topics
from docspark.sources import store as st
from docspark.streaming import feedback as feedback_stream
from docspark.streaming import json_objects, uploads


class BreaksOnce:
    """A publisher whose third send fails, once."""

    def __init__(self, publish):
        self.publish, self.sends = publish, 0

    def __call__(self, rows: DataFrame, name: str) -> None:
        self.sends += 1
        if self.sends == 3:
            raise RuntimeError("the topic is not there")
        self.publish(rows, name)


# --- landing -----------------------------------------------------------------

# The page's file name and bytes; every tenth file is empty, every third has no extension.
_INBOX = """SELECT 'page-' || CAST(page_id AS STRING) ||
    CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.HTML' ELSE '.tar.gz' END AS name,
    CASE WHEN page_id % 10 = 9 THEN '' ELSE html END AS content FROM pages"""
# Text functions that Spark and the checking engine share work on code points; sizes are of bytes.
_TAKEN = f"""SELECT name, content, CASE WHEN contains(name, '.')
    THEN substr(name, length(name) - position('.' IN reverse(name)) + 1) ELSE '.bin' END AS extension
  FROM ({_INBOX}) WHERE content <> ''"""


@query(
    f"""SELECT name AS source_name, extension, CAST(strlen(content) AS BIGINT) AS length,
      md5(content) AS content_md5, 'invoice' AS doc_type, 'queued' AS status, true AS addressed,
      CAST(1 AS BIGINT) AS messages FROM ({_TAKEN})"""
)
def landed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files through the landing job; stored bytes are found by the URI that the message names."""
    base = new_base(spark)
    store = st.Store(f"{base}/store", buckets=64)
    corpora.read(spark, sf_dir, "pages").createOrReplaceTempView("_pages")
    inbox = spark.sql(_INBOX.replace("FROM pages", "FROM _pages"))
    objects.write_objects(inbox.select("name", F.encode("content", "UTF-8").alias("content")), f"{base}/inbox")
    publish = BreaksOnce(topics.directory_publisher(f"{base}/topic"))
    job = uploads.LandingJob(store, "invoice", publish)
    source = files.stream_files(spark, f"{base}/inbox")
    # The first run stops at the broken topic; the second one runs its batch again.
    for _ in range(2):
        started = uploads.start_landing(source, job, f"{base}/checkpoint")
        try:
            started.awaitTermination()
        except Exception as error:
            if "the topic is not there" not in str(error):
                raise
    sent = messages.valid(messages.decode_uploads(spark.read.parquet(f"{base}/topic").select("value")))
    counted = sent.groupBy("doc_id", "file_path", "doc_type").agg(F.count("*").alias("messages"))
    stored = files.read_files(files.many_files(spark), store.objects).select(
        F.substring_index("path", "/", -1).alias("_name"), "length", F.md5("content").alias("content_md5")
    )
    known = spark.read.parquet(store.raw).select("doc_id", F.substring_index("source_path", "/", -1).alias("source_name"))
    status = st.manifests(spark, store).select("doc_id", "status")
    indexed = landed.index(spark, store).select(F.col("path").alias("file_path"), F.col("doc_id").alias("_indexed"))
    joined = (
        counted.withColumn("_name", F.substring_index("file_path", "/", -1))
        .join(stored, "_name")
        .join(known, "doc_id")
        .join(status, "doc_id")
        .join(indexed, "file_path")
    )
    return joined.select(
        "source_name",
        F.expr("substring(_name, length(doc_id) + 1)").alias("extension"),
        "length",
        "content_md5",
        "doc_type",
        "status",
        ((F.col("_indexed") == F.col("doc_id")) & F.col("_name").startswith(F.col("doc_id"))).alias("addressed"),
        "messages",
    )


# Files land on ten days, in five batches.
ARRIVAL = "1700000000 + CAST(length % 10 AS BIGINT) * 86400"
_LANDED = f"""SELECT path, length, 'd' || path AS doc_id, CAST(length % 5 AS INT) AS batch,
    {ARRIVAL} AS seconds FROM ({_FILES})"""


def landed_index(spark: SparkSession, sf_dir: str, store: st.Store, batches: int = 5, again: int = 1) -> None:
    """The rendered file table brought into the landing index, a batch at a time, the last one `again`."""
    corpora.read(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    rows = spark.sql(_LANDED.replace("FROM documents", "FROM _documents")).select(
        F.col("path").alias("file_path"),
        "doc_id",
        "length",
        F.timestamp_seconds("seconds").alias("modificationTime"),
        F.pmod("batch", F.lit(batches)).alias("batch"),
    )
    for batch in [*range(batches), *[batches - 1] * again]:
        part = rows.filter(F.col("batch") == batch).drop("batch")
        st.write_batch(part, store.raw, batch)
        landed.merge(part, store)


@query(
    f"""{_DECODED}, files AS ({_LANDED}) SELECT seq, decoded.doc_id, length,
      CAST(to_timestamp(seconds) AS DATE) AS arrived,
      CASE WHEN length IS NULL THEN 'file_not_found' END AS reason
      FROM decoded LEFT JOIN files ON replace(path, 'file:/', 'file:///') = file_path
      WHERE reason IS NULL"""
)
def landing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload events and their files in the landing index, after several batches and one replay."""
    store = st.Store(f"{new_base(spark)}/store", buckets=64)
    landed_index(spark, sf_dir, store)
    events = messages.valid(messages.decode_uploads(corpora.upload_values(spark, sf_dir)))
    found = files.with_files(events, landed.lookup(events, store))
    return found.select("seq", "doc_id", "length", "arrived", "reason")


# --- publication -------------------------------------------------------------


@query(
    f"""{_DECODED}, plain AS ({corpora.SQL["plain"]}), mixed AS (
        SELECT doc_id, 'plain' AS kind, text, nullif(k.doc_type, 'unknown') AS hint
        FROM (SELECT * FROM decoded WHERE reason IS NULL) k JOIN plain USING (doc_id)),
      typed AS ({FIELD_TABLES.split("typed AS (", 1)[1].split(", fields AS (", 1)[0]}
      SELECT doc_id AS key, doc_type, confidence, true AS has_uri, CAST(1 AS BIGINT) AS messages FROM typed"""
)
def processed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of processed documents, after a send has broken and the batch has run twice more."""
    base = new_base(spark)
    store = st.Store(f"{base}/store")
    texts = DocumentTables(texts=corpora.plain(spark, sf_dir).select("doc_id", "text"))
    publish = BreaksOnce(topics.directory_publisher(f"{base}/topic"))
    job = uploads.UploadJob(store, lambda: texts, publish=publish)
    batch = corpora.upload_values(spark, sf_dir)
    for _ in range(3):
        job.run_batch(batch, 0)
    sent = spark.read.parquet(f"{base}/topic")
    body = F.from_json("value", "doc_type STRING, confidence DOUBLE, json_uri STRING")
    return (
        sent.select("key", body.alias("b"))
        .groupBy("key", "b.doc_type", "b.confidence")
        .agg(F.every(F.endswith("b.json_uri", F.concat(F.lit("#"), "key"))).alias("has_uri"), F.count("*").alias("messages"))
    )


@query(
    f"""{corpora.with_tables("feedback")} SELECT event_id, doc_id AS key, field, predicted, actual, ts,
      CAST(1 AS BIGINT) AS messages FROM feedback"""
)
def feedback_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of feedback events, after a send has broken and the batch has run twice more."""
    base = new_base(spark)
    events = corpora.feedback(spark, sf_dir)
    batch = events.select(
        F.to_json(F.struct(*events.columns)).alias("value"), F.col("event_id").cast("bigint").alias("seq")
    )
    publish = BreaksOnce(topics.directory_publisher(f"{base}/topic"))
    job = feedback_stream.FeedbackJob(st.Store(f"{base}/store"), publish)
    for _ in range(3):
        job.run_batch(batch, 0)
    body = messages.json_object(F.col("value"), schemas.FEEDBACK)
    sent = spark.read.parquet(f"{base}/topic").select("key", body.alias("b"))
    columns = ["b.event_id", "key", "b.field", "b.predicted", "b.actual", "b.ts"]
    return sent.groupBy(*columns).agg(F.count("*").alias("messages"))


# --- model versions ----------------------------------------------------------


@query(
    """SELECT 'region-' || CAST(n_regionkey AS STRING) AS name,
      CAST(row_number() OVER (PARTITION BY n_regionkey) AS INT) AS version, 'Staging' AS stage FROM nation"""
)
def registry_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that many jobs register at the same time, one for every nation."""
    store = st.Store(f"{new_base(spark)}/store")
    names = [f"region-{r.n_regionkey}" for r in corpora.read(spark, sf_dir, "nation").collect()]
    with ThreadPoolExecutor(8) as jobs:
        list(jobs.map(lambda name: training.add_version(spark, store, name, "Staging", "run", "path"), names))
    return training.versions(spark, store).select("name", "version", "stage")


# --- files of one JSON object each -------------------------------------------

# What is wrong with the file of a key, if anything.
_FAULT = """CASE WHEN {key} % 7 = 3 THEN 'cut' WHEN {key} % 11 = 4 THEN 'list' WHEN {key} % 13 = 5 THEN 'no id'
  WHEN {key} % 17 = 6 THEN 'other' ELSE 'none' END"""
_REASON = "CASE fault WHEN 'no id' THEN 'missing_doc_id' ELSE 'invalid_json_object' END"


def _batch() -> Column:
    return F.col(st.BATCH).cast("bigint").alias(st.BATCH)


def _with_faults(rows: DataFrame, key: str) -> DataFrame:
    """Files (key, name, content) of rows (key, doc_id, name, object): indented JSON, some of it broken."""
    fault = F.expr(_FAULT.format(key=key))
    text = F.col("object")
    broken = (
        F.when(fault == "cut", F.expr("substring(object, 1, length(object) - 1)"))
        .when(fault == "list", F.concat(F.lit("["), text, F.lit("]")))
        .when(fault == "no id", F.replace(text, F.lit('"doc_id"'), F.lit('"id"')))
        .otherwise(text)
    )
    suffix = F.when(fault == "other", ".txt").otherwise(".json")
    return rows.select(key, F.concat("name", suffix).alias("name"), F.encode(broken, "UTF-8").alias("content"))


def _object_table(spark: SparkSession, rows: DataFrame, key: str, schema) -> json_objects.ObjectTableJob:
    """Object files of even keys read as a stream, then those of odd keys by a second run."""
    base = new_base(spark)
    job = json_objects.ObjectTableJob(f"{base}/table", f"{base}/letters", schema)
    for odd in (0, 1):
        part = _with_faults(rows, key).filter(F.pmod(key, F.lit(2)) == odd)
        objects.write_objects(part, f"{base}/objects/{odd}")
        source = json_objects.stream_objects(spark, f"{base}/objects")
        json_objects.start(source, job, f"{base}/checkpoint").awaitTermination()
    return job


def _processed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpora.mixed(spark, sf_dir).filter("kind = 'kyc'")
    events = texts.select("doc_id", F.concat(F.lit("/raw/"), "doc_id").alias("file_path"), F.lit("unknown").alias("doc_type"))
    rows = process(events, documents(DocumentTables(texts=texts)))
    body = F.to_json(F.struct(*schemas.PROCESSED.names), {"pretty": "true"})
    number = F.substring_index("doc_id", "-", -1).cast("bigint")
    return rows.select(number.alias("key"), F.col("doc_id").alias("name"), body.alias("object"))


_KYC = FIELD_TABLES.replace("hint IN ('', 'unknown')", "true").replace("FROM mixed", "FROM mixed WHERE kind = 'kyc'")


@query(
    f"""{_KYC} SELECT doc_id, doc_type, confidence, {json_fields()} AS fields,
      CAST(key % 2 AS BIGINT) AS batch_id FROM (SELECT *, CAST(string_split(doc_id, '-')[2] AS BIGINT) AS key
        FROM fields) WHERE {_FAULT.format(key="key")} = 'none'"""
)
def processed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented object files of processed documents, with others beside them, read by two runs of a stream."""
    job = _object_table(spark, _processed_files(spark, sf_dir), "key", schemas.PROCESSED)
    fields = fields_json(F.col("doc_type"), F.col("fields"))
    return job.latest(spark).select("doc_id", "doc_type", "confidence", fields.alias("fields"), _batch())


_CORRECTIONS = """SELECT doc_id AS key, 'plain-' || CAST(doc_id AS STRING) AS doc_id,
    'e' || CAST(doc_id AS STRING) AS event_id, 'quality' AS field, CAST(toxic AS STRING) AS predicted,
    CAST(quality AS STRING) AS actual FROM labels"""


def _feedback_job(spark: SparkSession, sf_dir: str) -> json_objects.ObjectTableJob:
    corpora.read(spark, sf_dir, "labels").createOrReplaceTempView("_labels")
    rows = spark.sql(_CORRECTIONS.replace("FROM labels", "FROM _labels"))
    body = F.to_json(F.struct("event_id", "doc_id", "field", "predicted", "actual"), {"pretty": "true"})
    return _object_table(spark, rows.select("key", F.col("event_id").alias("name"), body.alias("object")), "key", schemas.FEEDBACK)


@query(
    f"""SELECT doc_id, event_id, field, predicted, actual, CAST(key % 2 AS BIGINT) AS batch_id
      FROM ({_CORRECTIONS}) WHERE {_FAULT.format(key="key")} = 'none'"""
)
def feedback_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented object files of feedback events, with others beside them, read by two runs of a stream."""
    job = _feedback_job(spark, sf_dir)
    return job.latest(spark, "event_id").select("doc_id", "event_id", "field", "predicted", "actual", _batch())


@query(
    f"""SELECT event_id || '.json' AS name, {_REASON} AS reason, CAST(key % 2 AS BIGINT) AS batch_id
      FROM (SELECT *, {_FAULT.format(key="key")} AS fault FROM ({_CORRECTIONS})) WHERE fault NOT IN ('none', 'other')"""
)
def object_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold no object of the table, by name."""
    letters = spark.read.parquet(_feedback_job(spark, sf_dir).dead_letters)
    return letters.select(F.substring_index("file", "/", -1).alias("name"), "reason", _batch())
