from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators.payload import payload_json
from docspark.functions.paths import path_key
from docspark.plans import corpora
from docspark.plans.catalog import ingest, pipelines, reading
from docspark.plans.process import DocumentTables, documents, process
from docspark.sources import files, filesystem, landed, messages, objects, partitions, store, topics
from docspark.streaming import feedback, json_objects, uploads
from docspark.streaming.outbox import Outbox

TEXTS = [("a", "Invoice # 7\nTotal USD 5"), ("b", "hello"), ("c", "Passport # X1234567")]


def event(doc_id, path=None, doc_type=None):
    body = {"doc_id": doc_id, "file_path": path or f"/raw/{doc_id}", "doc_type": doc_type}
    return json.dumps(body)


def put(spark, directory, values, first):
    rows = [(value, first + i) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, "value STRING, seq BIGINT")
    frame.coalesce(1).write.mode("append").parquet(directory)


@pytest.fixture
def job(spark, tmp_path):
    words = spark.createDataFrame(
        [("a", 0, i, f"w{i}", 0.5, 1, 2, 3, 4) for i in range(3)],
        "doc_id STRING, page INT, pos INT, text STRING, confidence DOUBLE, left INT, top INT, "
        "width INT, height INT",
    )
    tables = DocumentTables(spark.createDataFrame(TEXTS, "doc_id STRING, text STRING"), words)
    return uploads.UploadJob(
        store.Store(str(tmp_path / "store")),
        lambda: tables,
        publish=topics.directory_publisher(str(tmp_path / "out")),
    )


def run(spark, job, tmp_path):
    (tmp_path / "topic").mkdir(exist_ok=True)
    source = topics.directory_stream(spark, str(tmp_path / "topic"))
    query = uploads.start(source, job, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return query


def snapshot(spark, job):
    rows = store.processed(spark, job.store)
    return sorted(map(tuple, rows.select("doc_id", payload_json()).collect()))


def test_batches_restart_and_overwrite(spark, job, tmp_path):
    put(spark, str(tmp_path / "topic"), [event("a"), event("b"), "{bad", "", event("zz")], 0)
    run(spark, job, tmp_path)
    first = snapshot(spark, job)
    assert [doc_id for doc_id, _ in first] == ["a", "b"]
    letters = spark.read.parquet(job.store.dead_letters)
    assert sorted(map(tuple, letters.select("seq", "reason").collect())) == [
        (2, "invalid_json_object"),
        (4, "text_not_found"),
    ]

    run(spark, job, tmp_path)  # nothing new
    assert snapshot(spark, job) == first
    assert store.processed_versions(spark, job.store).count() == 2

    put(spark, str(tmp_path / "topic"), [event("b", doc_type="contract"), event("c"), event("c", doc_type="kyc2")], 5)
    run(spark, job, tmp_path)
    last = {doc_id: json.loads(payload) for doc_id, payload in snapshot(spark, job)}
    assert {d: p["doc_type"] for d, p in last.items()} == {"a": "invoice", "b": "contract", "c": "kyc2"}
    assert last["a"]["layout"]["line_count"] == 3
    assert store.processed_versions(spark, job.store).count() == 5

    status = {r.doc_id: r for r in store.manifests(spark, job.store).collect()}
    assert status["b"].status == "processed" and status["b"].doc_type == "contract"
    published = spark.read.parquet(str(tmp_path / "out"))
    assert published.count() == 5
    value = json.loads(published.filter("key = 'a'").first()["value"])
    assert value["json_uri"] == status["a"].processed_uri
    del value["json_uri"]
    assert value == last["a"]


def test_replay_of_a_batch(spark, job):
    batch = spark.createDataFrame([(event("a"), 0), (event("b"), 1), ("{", 2)], "value STRING, seq BIGINT")
    job.run_batch(batch, 3)
    once = snapshot(spark, job)
    job.run_batch(batch, 3)
    assert snapshot(spark, job) == once
    assert store.processed_versions(spark, job.store).count() == 2
    assert spark.read.parquet(job.store.dead_letters).count() == 1


def test_stream_equals_batch(spark, job, tmp_path):
    values = [event(doc_id, doc_type=hint) for doc_id, hint in zip("abc", [None, "unknown", "kyc"], strict=True)]
    put(spark, str(tmp_path / "topic"), values, 0)
    run(spark, job, tmp_path)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value STRING, seq BIGINT")
    events = messages.valid(messages.decode_uploads(frame))
    rows = process(events, documents(job.tables()))
    assert sorted(map(tuple, rows.select("doc_id", payload_json()).collect())) == snapshot(spark, job)


def test_missing_files(spark, job, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a").write_bytes(b"x")
    checked = uploads.UploadJob(
        job.store, job.tables, files=lambda: files.read_files(spark, str(tmp_path / "raw"))
    )
    values = [event("a", f"file://{tmp_path}/raw/a"), event("b", f"{tmp_path}/raw/b"), "[]"]
    batch = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value STRING, seq BIGINT")
    checked.run_batch(batch, 0)
    assert [d for d, _ in snapshot(spark, job)] == ["a"]
    letters = spark.read.parquet(job.store.dead_letters).select("seq", "reason").collect()
    assert sorted(map(tuple, letters)) == [(1, "file_not_found"), (2, "invalid_json_object")]


def test_landed_files_feed_the_upload_job(spark, job, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "x.png").write_bytes(b"data")
    landing = uploads.LandingJob(job.store, publish=topics.directory_publisher(str(tmp_path / "q")))
    source = files.stream_files(spark, str(inbox))
    uploads.start_landing(source, landing, str(tmp_path / "cp")).awaitTermination()
    sent = spark.read.parquet(str(tmp_path / "q"))
    texts = sent.select(F.col("key").alias("doc_id"), F.lit("kyc").alias("text"))
    known = uploads.UploadJob(
        job.store, lambda: DocumentTables(texts), from_landing=True
    )
    known.run_batch(sent.select("value", F.lit(0).cast("bigint").alias("seq")), 0)
    row = store.processed(spark, job.store).first()
    assert (row.doc_id, row.doc_type) == (sent.first().key, "kyc")
    status = store.manifests(spark, job.store).first()
    assert (status.status, status.doc_type) == ("processed", "unknown")


def test_failed_publishing(spark, job):
    def fail(messages, batch_id):
        raise RuntimeError("no broker")

    batch = spark.createDataFrame([(event("a"), 0)], "value STRING, seq BIGINT")
    uploads.UploadJob(job.store, job.tables, publish=fail).run_batch(batch, 0)
    assert [d for d, _ in snapshot(spark, job)] == ["a"]
    strict = uploads.UploadJob(job.store, job.tables, publish=fail, publish_required=True)
    with pytest.raises(RuntimeError):
        strict.run_batch(batch, 0)


def test_compaction(spark, job, tmp_path):
    for i in range(2):
        rows = [(event("a"), 0), (event("b"), 1)]
        job.run_batch(spark.createDataFrame(rows, "value STRING, seq BIGINT"), i)
    target = store.Store(str(tmp_path / "compact"))
    store.compact_processed(spark, job.store, target)
    assert store.processed_versions(spark, target).count() == 2
    rows = store.processed(spark, target)
    got = sorted(map(tuple, rows.select("doc_id", payload_json()).collect()))
    assert got == snapshot(spark, job)


def partitions_read(frame):
    """Partitions that each partitioned scan of an executed plan has opened."""
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec" and node.metrics().contains("numPartitions"):
                found.append(node.metrics().apply("numPartitions").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_document_tables_open_only_the_days_of_the_events(spark, tmp_path):
    days = [f"2024-03-{d:02}" for d in range(1, 21)]
    texts = spark.createDataFrame([(f"{d}-{i}", "t", d) for d in days for i in range(5)], "doc_id STRING, text STRING, arrived STRING")
    texts = texts.withColumn("arrived", F.col("arrived").cast("date"))
    for batch_id in (0, 1, 1):
        part = texts.filter(F.dayofmonth("arrived") % 2 == batch_id)
        partitions.write_arrivals(part, str(tmp_path / "t"), batch_id)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 100
    events = texts.filter("doc_id IN ('2024-03-07-1', '2024-03-08-4')").select("doc_id", "arrived")
    kept = DocumentTables(table).restricted(events).texts
    assert sorted(r.doc_id for r in kept.collect()) == ["2024-03-07-1", "2024-03-08-4"]
    assert partitions_read(kept) == [2]
    # Events that do not know the day are looked for on all days.
    assert DocumentTables(table).restricted(events.drop("arrived")).texts.count() == 2


def landing_rows(spark, names, hour):
    rows = [(f"/raw/{n}", f"id-{n}-{hour}", 10 + hour, f"2024-05-01 {hour:02}:00:00") for n in names]
    frame = spark.createDataFrame(rows, "file_path STRING, doc_id STRING, length BIGINT, t STRING")
    return frame.withColumn("modificationTime", F.col("t").cast("timestamp")).drop("t")


def test_index_reads_and_rewrites_only_partitions_of_its_batch(spark, tmp_path):
    where = store.Store(str(tmp_path / "store"))
    for batch_id in range(12):
        batch = landing_rows(spark, [f"b{batch_id}-{i}" for i in range(4)] + ["same"], batch_id)
        store.write_batch(batch, where.raw, batch_id)
        landed.merge(batch, where)
    everything = sorted(map(tuple, landed.index(spark, where).collect()))
    assert len(everything) == 12 * 4 + 1
    assert [r[1] for r in everything if r[0] == "/raw/same"] == ["id-same-11"]

    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "landed").rglob("*.parquet")}
    landed.merge(landing_rows(spark, ["b3-1", "same"], 3), where)  # an older batch once more
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "landed").rglob("*.parquet")}
    assert sorted(map(tuple, landed.index(spark, where).collect())) == everything
    assert len(set(before.items()) - set(after.items())) == 2

    events = spark.createDataFrame([("/raw/b5-2",), ("file:///raw/same",), ("/raw/none",)], "file_path STRING")
    found = landed.lookup(events, where)
    assert {r.path for r in found.collect()} >= {"/raw/b5-2", "/raw/same"}
    assert len(partitions_read(found)) == 1 and partitions_read(found)[0] <= 3


def test_before_anything_has_landed_no_file_is_found(spark, job):
    checked = uploads.UploadJob(job.store, job.tables, from_landing=True)
    batch = spark.createDataFrame([(event("a"), 0)], "value STRING, seq BIGINT")
    checked.run_batch(batch, 0)
    letters = spark.read.parquet(job.store.dead_letters).select("seq", "reason").collect()
    assert list(map(tuple, letters)) == [(0, "file_not_found")]


def test_an_interrupted_merge_is_made_good_from_the_log(spark, tmp_path):
    where = store.Store(str(tmp_path / "store"))
    for batch_id in range(3):
        batch = landing_rows(spark, [f"b{batch_id}-{i}" for i in range(3)], batch_id)
        store.write_batch(batch, where.raw, batch_id)
        landed.merge(batch, where)
    everything = sorted(map(tuple, landed.index(spark, where).collect()))
    lost = landed.index(spark, where).filter("path = '/raw/b1-1'").first().path_bucket
    filesystem.create_if_absent(spark, f"{where.landed}_merging", "")
    filesystem.delete(spark, f"{where.landed}/path_bucket={lost}")
    landed.merge(landing_rows(spark, ["b2-0"], 2), where)
    assert sorted(map(tuple, landed.index(spark, where).collect())) == everything
    assert not filesystem.exists(spark, f"{where.landed}_merging")


def test_landing(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "x.PDF").write_bytes(b"data")
    (inbox / "empty").write_bytes(b"")
    where = store.Store(str(tmp_path / "store"))
    job = uploads.LandingJob(where, "invoice", topics.directory_publisher(str(tmp_path / "out")))

    def run_landing():
        source = files.stream_files(spark, str(inbox))
        uploads.start_landing(source, job, str(tmp_path / "cp")).awaitTermination()

    run_landing()
    raw = spark.read.parquet(where.raw).first()
    assert raw.stored_name == raw.doc_id + ".PDF" and raw.source_path.endswith("/inbox/x.PDF")
    (inbox / "x.PDF").unlink()
    stored = files.read_files(spark, where.objects).collect()
    assert [(f.path.split("/")[-1], bytes(f.content)) for f in stored] == [(raw.stored_name, b"data")]
    named = spark.createDataFrame([(raw.file_path,), (stored[0].path,)], "path STRING")
    assert named.select(path_key(F.col("path"))).distinct().count() == 1
    manifest = store.manifests(spark, where).first()
    assert (manifest.doc_id, manifest.status, manifest.doc_type) == (raw.doc_id, "queued", "invoice")
    message = spark.read.parquet(str(tmp_path / "out")).first()
    assert message.key == raw.doc_id
    assert json.loads(message.value) == {
        "doc_id": raw.doc_id,
        "file_path": raw.file_path,
        "doc_type": "invoice",
    }
    known = store.raw_files(spark, where).collect()
    assert [(r.path, r.length) for r in known] == [(raw.file_path, 4)]
    (inbox / "y").write_bytes(b"more")
    run_landing()
    assert spark.read.parquet(where.raw).count() == 2


def test_feedback_stream(spark, tmp_path):
    rows = [{"doc_id": "a", "field": "doc_type", "actual": "kyc", "ts": "t"}, {"event_id": "e", "doc_id": "b"}]
    put(spark, str(tmp_path / "topic"), [json.dumps(r) for r in rows] + ["[]"], 0)
    where = store.Store(str(tmp_path / "store"))
    job = feedback.FeedbackJob(where, topics.directory_publisher(str(tmp_path / "out")))
    source = topics.directory_stream(spark, str(tmp_path / "topic"))
    feedback.start(source, job, str(tmp_path / "cp")).awaitTermination()
    log = {r.doc_id: r for r in store.feedback(spark, where).collect()}
    assert log["b"].event_id == "e" and log["a"].event_id
    letters = spark.read.parquet(where.feedback_dead_letters).collect()
    assert [(r.value, r.reason) for r in letters] == [("[]", "invalid_json_object")]
    sent = {r.key: json.loads(r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sent["a"] == {**dict.fromkeys(schemas.FEEDBACK.names), **rows[0], "event_id": log["a"].event_id}


def test_a_batch_reads_only_its_own_partition(spark, tmp_path):
    where = store.Store(str(tmp_path / "store"))
    plain = spark.range(3).select(F.col("id").cast("string").alias("doc_id"))
    rows = plain.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in store._PROCESSED_ROWS if f.name not in ("doc_id", "batch_id", "usable")}
    )
    for batch_id in range(12):
        store.write_processed(rows, where, batch_id)
    one = store.processed_versions(spark, where, 7)
    assert one.count() == 3 and {r.batch_id for r in one.collect()} == {7}
    assert all("/batch_id=7/" in f for f in one.inputFiles())
    assert store.processed_versions(spark, where).count() == 36


def test_ids_of_events_without_one(spark):
    rows = [("", "a"), ("", "b"), (None, "c"), ("", "a"), ("x", "d")]
    events = spark.createDataFrame(rows, "event_id STRING, doc_id STRING")
    others = {n: F.lit(None).cast("string") for n in schemas.FEEDBACK.names if n not in events.columns}
    log = store.with_ids(events.withColumns(others))
    assert store.latest_feedback(log).count() == 5


def test_feedback_replay_writes_the_same_ids(spark, tmp_path):
    where = store.Store(str(tmp_path / "store"))
    job = feedback.FeedbackJob(where)
    values = [json.dumps({"event_id": e, "doc_id": "a", "field": "f", "actual": "x"}) for e in ("", "", None, "e")]
    batch = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value STRING, seq BIGINT")
    job.run_batch(batch, 0)
    first = {r.event_id for r in store.feedback(spark, where).collect()}
    job.run_batch(batch, 0)
    assert {r.event_id for r in store.feedback(spark, where).collect()} == first
    assert len(first) == 4 and "" not in first


def test_outbox_sends_each_part_once(spark, tmp_path):
    sent, broken = [], {"3-1"}

    def publish(rows, name):
        if name in broken:
            raise RuntimeError("no broker")
        sent.extend(map(tuple, rows.collect()))

    box = Outbox(str(tmp_path / "box"), publish, parts=4)
    rows = [(f"k{i}", f"v{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "key STRING, value STRING")
    box.put(frame, 3)
    assert not box.flush(spark) and 0 < len(sent) < 40
    with pytest.raises(RuntimeError):
        box.flush(spark, required=True)
    box.put(spark.createDataFrame([("k0", "changed")], "key STRING, value STRING"), 3)  # a replay changes nothing
    broken.clear()
    box.put(spark.createDataFrame([("later", "v")], "key STRING, value STRING"), 4)
    assert box.flush(spark) and sorted(sent[:40]) == sorted(rows) and sent[40:] == [("later", "v")]
    box.put(frame, 3)
    assert box.flush(spark) and len(sent) == 41 and box.pending(spark) == []


def test_objects_of_failed_tasks_do_not_appear(spark, tmp_path):
    rows = [(f"n{i}" if i != 77 else "bad/name", bytes([i])) for i in range(100)]
    frame = spark.createDataFrame(rows, "name STRING, content BINARY").repartition(4)
    with pytest.raises(Exception, match="no name"):
        objects.write_objects(frame, str(tmp_path / "o"))
    assert [f for f in (tmp_path / "o").rglob("*") if f.is_file()] == []
    good = frame.filter("name NOT LIKE '%/%'")
    objects.write_objects(good, str(tmp_path / "o"))
    objects.write_objects(good.filter("name = 'n5'").withColumn("content", F.lit(b"new")), str(tmp_path / "o"))
    found = {f.name: f.read_bytes() for f in (tmp_path / "o").iterdir() if f.is_file()}
    assert found == {n: (b"new" if n == "n5" else c) for n, c in rows if "/" not in n}
    assert list((tmp_path / "o" / "_staging").iterdir()) == []


@pytest.mark.parametrize("kind", ["json", "binary"])
def test_many_small_files_of_a_stream_are_read_by_few_tasks(spark, tmp_path, kind):
    rows = spark.range(400).selectExpr("concat(id, '.json') AS name", "encode('{}', 'UTF-8') AS content")
    folder, parts = f"{tmp_path}/objects", []
    objects.write_objects(rows, folder)
    source = files.stream_files(spark, folder) if kind == "binary" else json_objects.stream_objects(spark, folder)

    def run(batch, batch_id):
        parts.append((batch.rdd.getNumPartitions(), batch.count()))

    started = source.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/checkpoint")
    started.trigger(availableNow=True).start().awaitTermination()
    # At 4 MB a file they are 13 parts of 32 files.
    assert len(parts) == 1 and parts[0][0] <= 8 and parts[0][1] == 400


def test_a_session_for_many_files_is_like_the_given_one(spark):
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    assert files.many_files(spark).conf.get(name) == "64k" and spark.conf.get(name) == before
    assert files.many_files(spark).conf.get("spark.sql.session.timeZone") == "UTC"
    spark.conf.set(name, "1m")
    try:
        assert files.many_files(spark).conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_documents_get_their_day_before_they_are_made_into_words(spark, tmp_path):
    """The rows are those of words joined with the days of their documents, repeated ids and nulls included."""
    given = [(i, "Some words Of text " * (i + 1)) for i in range(12)] + [(3, "Twice given"), (4, None), (None, "No id")]
    spark.createDataFrame(given, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    sf_dir = str(tmp_path)
    plain = corpora.plain(spark, sf_dir)
    day = F.to_date(F.timestamp_seconds(F.expr(ingest.ARRIVAL)))
    days = plain.withColumn("length", F.length("text")).select("doc_id", day.alias("arrived"))
    docs = plain.join(days, "doc_id")
    pairs = [
        (reading.words(spark, sf_dir, docs), reading.words(spark, sf_dir)),
        (corpora.exploded(corpora.entity_responses(spark, sf_dir, docs)), corpora.exploded(corpora.entity_responses(spark, sf_dir))),
        (corpora.exploded(corpora.key_phrase_responses(spark, sf_dir, docs)), corpora.exploded(corpora.key_phrase_responses(spark, sf_dir))),
    ]
    tables = pipelines._arrived_tables(spark, sf_dir, f"{tmp_path}/tables")
    written = (tables.blocks, tables.entities, tables.key_phrases)
    for (dated, rows), table in zip(pairs, written, strict=True):
        expected = rows.join(days, "doc_id")
        names = expected.columns
        assert dated.count() == expected.count() == table.count() > 12
        assert dated.select(names).exceptAll(expected).isEmpty()
        assert table.select(names).exceptAll(expected).isEmpty()
    assert tables.texts.count() == docs.count() == 18


def test_rows_of_many_documents_are_limited_before_they_are_shuffled(spark, monkeypatch):
    """Against many ids only texts are joined; the documents of the events come out as against few."""
    words = [(f"d{d}", 0, pos, f"w{pos}", 1, 2, 3, 4, 0.5) for d in range(4) for pos in range(60)] + [(None, 0, 0, "x", 1, 2, 3, 4, 0.5)]
    entities = [(f"d{d}", pos, f"Name {pos}", "PERSON" if pos == 55 else "DATE", 0.5) for d in range(4) for pos in range(60)]
    columns = "doc_id STRING, page INT, pos INT, text STRING, left INT, top INT, width INT, height INT, confidence DOUBLE"
    tables = DocumentTables(
        texts=spark.createDataFrame([(f"d{d}", f"text {d}") for d in range(4)] + [(None, "none")], "doc_id STRING, text STRING"),
        blocks=spark.createDataFrame(words, columns),
        entities=spark.createDataFrame(entities, "doc_id STRING, pos INT, Text STRING, Type STRING, Score DOUBLE"),
    )
    rows = [("d1", "/raw/1", "unknown"), ("d3", "/raw/3", "unknown"), ("d3", "/raw/3", "kyc"), ("d9", "/raw/9", "unknown")]
    events = spark.createDataFrame(rows, "doc_id STRING, file_path STRING, doc_type STRING")

    def results():
        return process(events, documents(tables.restricted(events)))

    few = results()
    assert tables.restricted(events).blocks.count() == 120
    monkeypatch.setattr("docspark.plans.process.is_small", lambda df: False, raising=False)
    restricted = tables.restricted(events)
    for table in (restricted.blocks, restricted.entities):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
        assert table.filter("doc_id IS NULL").isEmpty()
    assert restricted.texts.count() == 2
    many = results()
    assert many.count() == few.count() == 4 and many.exceptAll(few).isEmpty()
    found = many.filter("doc_id = 'd1'").first()
    assert (found.layout.line_count, len(found.layout.lines), found.fields.name) == (60, 40, "Name 55")


def test_documents_are_dealt_once_for_all_their_tables(spark, tmp_path, monkeypatch):
    given = [(i, "Some words Of text " * (i + 1)) for i in range(12)]
    spark.createDataFrame(given, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    plans, words = [], reading.words

    def seen(session, sf_dir, docs):
        plans.append(docs._jdf.queryExecution().executedPlan().toString())
        return words(session, sf_dir, docs)

    monkeypatch.setattr(reading, "words", seen)
    tables = pipelines._arrived_tables(spark, str(tmp_path), f"{tmp_path}/tables")
    assert len(plans) == 1 and "Exchange" not in plans[0] and "FileScan parquet" in plans[0]
    assert sorted(tables.texts.columns) == ["arrived", "batch_id", "doc_id", "text"]


def test_short_parts_keep_what_the_session_sets(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    assert files.short_parts(spark).conf.get(name) == "16m" and spark.conf.get(name) == before
    spark.conf.set(name, "1m")
    try:
        assert files.short_parts(spark).conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
