from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import paths
from docspark.operators import entities as E
from docspark.operators import keyed, ocr
from docspark.operators.payload import payload_json
from docspark.plans import corpora
from docspark.plans.catalog import reading
from docspark.plans.process import DocumentTables, documents, process
from docspark.sources import partitions
from docspark.streaming import json_objects


def rows_of(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("path", "suffix", "stored"),
    [
        ("a.PDF", ".pdf", "id.PDF"),
        ("b", ".png", "id.bin"),
        ("x/y.TIF?v=1.2", ".tif", None),
        (".hidden", ".png", "id.bin"),
        ("a.", ".png", "id.bin"),
        ("a.b/c", ".png", "id.bin"),
        ("a/b.c.d/", ".d", "id.d"),
        ("..x", ".x", "id.x"),
    ],
)
def test_suffix_and_stored_name(spark, path, suffix, stored):
    frame = spark.createDataFrame([(path,)], "p STRING")
    got = frame.select(paths.suffix(F.col("p")), paths.stored_name(F.lit("id"), F.col("p"))).first()
    assert got[0] == suffix
    assert stored is None or got[1] == stored


def test_uri_parts(spark):
    frame = spark.createDataFrame([("s3://b/k/x.png",), ("s3://b",), ("/a/b",)], "u STRING")
    u = F.col("u")
    got = frame.select(paths.bucket(u), paths.key(u), paths.storage_kind(u)).collect()
    assert [tuple(r) for r in got] == [("b", "k/x.png", "s3"), ("b", "", "s3"), ("", "a/b", "local")]


def test_words(spark):
    page = [
        ("d", 0, ["a", " ", "b ", "c", "d", None, "e"], ["96.5", "50", "-1", "n/a", None, "1", "0"])
    ]
    frame = spark.createDataFrame(page, "doc_id STRING, page INT, text ARRAY<STRING>, conf ARRAY<STRING>")
    for name in ("left", "top", "width", "height"):
        frame = frame.withColumn(name, F.expr("transform(text, (t, i) -> i * 10)"))
    clean = ocr.clean_words(ocr.words_from_arrays(frame))
    got = rows_of(clean.select("pos", "text", "confidence", "left"), "pos")
    assert got == [(0, "a", 0.965, 0), (6, "e", 0.0, 60)]


BLOCKS = "doc_id STRING, result_no INT, pos INT, BlockType STRING, Text STRING, Confidence DOUBLE, Page INT, bbox STRUCT<Left: DOUBLE, Top: DOUBLE, Width: DOUBLE, Height: DOUBLE>"  # noqa: E501


def test_lines_and_their_text(spark):
    blocks = spark.createDataFrame(
        [
            ("d", 1, 0, "LINE", "last", 50.0, 2, None),
            ("d", 0, 0, "PAGE", None, None, 1, None),
            ("d", 0, 2, "LINE", None, None, None, (0.1, 0.2, 0.3, 0.4)),
            ("d", 0, 1, "LINE", "first", 99.0, 1, None),
            ("d", 0, 3, "WORD", "w", 99.0, 1, None),
        ],
        BLOCKS,
    )
    lines = ocr.clean_lines(blocks)
    got = rows_of(lines.select("result_no", "pos", "text", "confidence", "page"), "result_no", "pos")
    assert got == [(0, 1, "first", 0.99, 1), (0, 2, "", 0.0, 1), (1, 0, "last", 0.5, 2)]
    assert ocr.line_text(lines).first()["text"] == "first\n\nlast"


def test_page_text_out_of_order(spark):
    pages = spark.createDataFrame(
        [("d", 2, " c "), ("d", 0, "a"), ("d", 1, ""), ("e", 0, None)],
        "doc_id STRING, page INT, text STRING",
    )
    assert rows_of(ocr.page_text(pages), "doc_id") == [("d", "a\n\n\n\nc"), ("e", "")]


@pytest.mark.parametrize("count", [0, 1, 40, 41])
def test_layout_sizes(spark, count):
    words = spark.range(count).selectExpr(
        "'d' AS doc_id", "CAST(id DIV 7 AS INT) AS page", "CAST(id % 7 AS INT) AS pos",
        "CAST(id AS STRING) AS text", "0.5D AS confidence", "1 AS left", "2 AS top", "3 AS width",
        "4 AS height",
    )
    texts = spark.createDataFrame([("d", "x")], "doc_id STRING, text STRING")
    events = spark.createDataFrame([("d", "/d", "unknown")], "doc_id STRING, file_path STRING, doc_type STRING")
    rows = process(events, documents(DocumentTables(texts, blocks=words)))
    payload = json.loads(rows.select(payload_json()).first()[0])
    if count == 0:
        assert "layout" not in payload
    else:
        assert payload["layout"]["line_count"] == count
        assert [b["text"] for b in payload["layout"]["lines"]] == [str(i) for i in range(min(count, 40))]
    assert "ml" not in payload


def test_sentinels(spark):
    frame = spark.createDataFrame(
        [("unreadable_image", None), ("no_pdf_renderer", None), ("pdf_failed", "bad"), ("ok", None)],
        "status STRING, message STRING",
    )
    text = ocr.text_or_sentinel(F.lit("t"), F.col("status"), F.col("message"))
    assert [r[0] for r in frame.select(text).collect()] == [
        "[unreadable image]",
        "[pdf2image not installed]",
        "[pdf conversion failed: bad]",
        "t",
    ]


def entity_table(spark, entities):
    return spark.createDataFrame(
        [("d", i, *e) for i, e in enumerate(entities)],
        "doc_id STRING, pos INT, Text STRING, Type STRING, Score DOUBLE",
    )


def payload_of(spark, text, entities, hint="unknown"):
    tables = DocumentTables(
        spark.createDataFrame([("d", text)], "doc_id STRING, text STRING"),
        entities=entity_table(spark, entities),
    )
    events = spark.createDataFrame([("d", "/d", hint)], "doc_id STRING, file_path STRING, doc_type STRING")
    rows = process(events, documents(tables))
    return json.loads(rows.select(payload_json()).first()[0])


def test_entity_merge(spark):
    many = [("", "PERSON", 0.9)] + [(f"p{i}", "DATE", None) for i in range(60)]
    many += [("Ann", "PERSON", 0.12345), ("Org", "ORGANIZATION", 1.0), ("Bob", "PERSON", 0.5)]
    payload = payload_of(spark, "hello", many)
    assert list(payload["fields"]) == ["raw_preview", "name", "organization", "ml_entities"]
    assert payload["fields"]["name"] == "Ann"
    assert payload["fields"]["organization"] == "Org"
    assert len(payload["fields"]["ml_entities"]) == 25
    assert len(payload["ml"]["entities"]) == 50
    assert payload["ml"]["entities"][1] == {"text": "p0", "type": "DATE", "score": 0.0}


def test_entity_merge_keeps_name(spark):
    payload = payload_of(spark, "Jane\nresume", [("Ann", "PERSON", 0.5)])
    assert payload["fields"]["name"] == "Jane"
    assert list(payload["fields"]) == ["name", "email", "phone", "skills", "ml_entities"]


def test_no_entities_leave_fields(spark):
    payload = payload_of(spark, "hello", [])
    assert payload["fields"] == {"raw_preview": "hello"}
    assert payload["ml"] == {"entities": [], "key_phrases": []}


def test_blank_text_is_not_enriched(spark):
    payload = payload_of(spark, " \n", [("Ann", "PERSON", 0.5)])
    assert "ml" not in payload
    assert payload["fields"] == {"raw_preview": " \n"}


def test_numbering_over_blocks(spark):
    rows = spark.range(5000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 50 AS STRING) END AS doc_id",
        "CAST(id % 4 AS INT) AS page",
        "CAST(id AS INT) AS pos",
    )
    got = keyed.numbered(rows, "doc_id", "page", "pos", "n", chunk=16).collect()
    expected = {}
    for r in sorted(rows.collect()):
        expected.setdefault(r.doc_id, []).append((r.page, r.pos))
    assert len(got) == 5000
    assert all(expected[r.doc_id][r.n - 1] == (r.page, r.pos) for r in got)


def test_response_arrays(spark):
    frame = spark.sql(
        "SELECT array(named_struct('Text', 'a', 'Type', 'T', 'Score', CAST(NULL AS DOUBLE))) AS r "
        "UNION ALL SELECT NULL"
    )
    got = frame.select(E.entity_items(F.col("r"))).collect()
    assert sorted(len(r[0]) for r in got) == [0, 1]


def test_new_object_files_are_read_once(spark, tmp_path):
    inbox = tmp_path / "objects" / "deep"
    inbox.mkdir(parents=True)
    good = json.dumps({"doc_id": "a", "event_id": "e1", "actual": "kyc"}, indent=2)
    (inbox / "a.json").write_text(good)
    (inbox / "cut.json").write_text(good[:-1])
    (inbox / "list.json").write_text(f"[{good}]")
    (inbox / "noid.json").write_text('{"doc_id": ""}')
    (inbox / "bytes.json").write_bytes(b'{"doc_id": "\xff"}')
    (inbox / "a.txt").write_text(good)
    job = json_objects.ObjectTableJob(str(tmp_path / "t"), str(tmp_path / "d"), schemas.FEEDBACK)

    def run():
        source = json_objects.stream_objects(spark, str(tmp_path / "objects"))
        json_objects.start(source, job, str(tmp_path / "cp")).awaitTermination()

    run()
    assert [(r.doc_id, r.event_id) for r in job.latest(spark).collect()] == [("a", "e1")]
    letters = spark.read.parquet(job.dead_letters)
    assert {r.file.split("/")[-1]: r.reason for r in letters.collect()} == {
        "cut.json": "invalid_json_object", "list.json": "invalid_json_object",
        "bytes.json": "invalid_json_object", "noid.json": "missing_doc_id",
    }
    run()  # nothing new
    (inbox / "b.json").write_text(json.dumps({"doc_id": "a", "event_id": "e2"}))
    run()
    rows = spark.read.parquet(job.table)
    assert sorted((r.event_id, r.batch_id) for r in rows.collect()) == [("e1", 0), ("e2", 1)]
    assert [r.event_id for r in job.latest(spark).collect()] == ["e2"]


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_page_are_worked_out_once(spark):
    rows = [("d", 0, ["a", " ", "c"], ["90", "80", "n/a"]), ("d", 1, [" "], ["70"]), ("e", 0, None, None)]
    pages = spark.createDataFrame(rows, "doc_id STRING, page INT, text ARRAY<STRING>, conf ARRAY<STRING>")
    pages = pages.selectExpr("*", *(f"transform(text, w -> 1) AS {n}" for n in ("left", "top", "width", "height")))
    cut = ocr.word_pages(pages)
    assert _plan(cut).count("arrays_zip(") == 1
    assert [(r.doc_id, r.order, r.n, [b.text for b in r.blocks]) for r in cut.collect()] == [("d", 0, 1, ["a"])]


def test_a_page_carries_its_own_words_only(spark, tmp_path):
    rows = [(1, " ".join(f"w{i}" for i in range(450))), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    pages = corpora.ocr_word_arrays(spark, str(tmp_path)).select("doc_id", "page", "text")
    assert "explode" not in _plan(pages)
    sizes = {(r.doc_id, r.page): r.text and len(r.text) for r in pages.collect()}
    assert {k: v for k, v in sizes.items() if k[0] != "plain-3"} == {
        ("plain-1", 0): 200, ("plain-1", 1): 200, ("plain-1", 2): 50, ("plain-2", 0): 1,
    }


def test_texts_are_dealt_before_they_are_made_into_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partitions, "PART_CHARACTERS", 100)
    rows = [(i, " ".join(f"w{i}" for _ in range(60))) for i in range(40)] + [(1, "again"), (2, None), (None, "lost")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain = corpora.plain(spark, str(tmp_path))
    dealt = partitions.dealt_texts(plain, "doc_id", F.xxhash64("text"))
    # One part of a file, of 60 words in 40 rows, becomes parts of about 100 characters.
    assert plain.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() > 60
    assert reading.words(spark, str(tmp_path), dealt).exceptAll(reading.words(spark, str(tmp_path))).isEmpty()
    got = {r.doc_id: r.line_count for r in reading.layout_summary_words(spark, str(tmp_path)).collect()}
    whole = reading._summary(reading.words(spark, str(tmp_path)), ["page", "pos"])
    assert got == {r.doc_id: r.line_count for r in whole.collect()}
    assert "RepartitionByExpression" in _plan(reading.layout_summary_words(spark, str(tmp_path)))
