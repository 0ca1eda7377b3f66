"""One key holds a third of the rows: same results, and no task takes them all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import entities, feedback, keyed, ocr, tables
from docspark.operators.small import broadcast_if_small
from docspark.sources.files import with_files

ROWS = 60_000
KEY = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || CAST(id % 400 AS STRING) END"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(ROWS).selectExpr(
        f"{KEY} AS doc_id", "CAST(id AS INT) AS pos", "CAST(id % 5 AS INT) AS page", "'w' || id AS text"
    )


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_partial_limit_before_the_shuffle(spark, rows):
    first = keyed.first_rows(rows, ["doc_id"], ["pos"], 40, "rank")
    plan = plan_of(first)
    assert plan.index("WindowGroupLimit [doc_id") < plan.index("Exchange hashpartitioning(doc_id")
    assert "row_number(), 40, Partial" in plan
    got = first.filter("doc_id = 'hot'").select("pos").collect()
    assert sorted(r.pos for r in got) == [3 * i for i in range(40)]


def test_layout_of_a_hot_document(spark, rows):
    boxes = rows.selectExpr("*", "0.5D AS confidence", "1 AS left", "1 AS top", "1 AS width", "1 AS height")
    summary = ocr.layout_summary(boxes, ["page", "pos"]).filter("doc_id = 'hot'").first()
    assert summary.line_count == ROWS // 3
    expected = sorted((i % 5, i) for i in range(0, ROWS, 3))[:40]
    assert [b.text for b in summary.layout_lines] == [f"w{i}" for _, i in expected]


def test_numbering_of_a_hot_document(spark, rows):
    numbered = keyed.numbered(rows, "doc_id", "page", "pos", "n", chunk=1024)
    hot = {r.n: r.pos for r in numbered.filter("doc_id = 'hot'").collect()}
    expected = sorted((i % 5, i) for i in range(0, ROWS, 3))
    assert hot == {n + 1: pos for n, (_, pos) in enumerate(expected)}
    plan = plan_of(numbered)
    assert "row_number() windowspecdefinition(doc_id" in plan
    assert plan.count("_block") > 0


def test_latest_of_a_hot_document(spark, rows):
    latest = tables.latest_processed(rows, ["page", "pos"])
    expected = max((i % 5, i) for i in range(0, ROWS, 3))[1]
    assert latest.filter("doc_id = 'hot'").first().pos == expected


def test_override_of_a_hot_document(spark, rows):
    log = rows.selectExpr(
        "CAST(pos AS STRING) AS event_id", "doc_id", "'doc_type' AS field", "CAST(NULL AS STRING) AS predicted",
        "text AS actual", "lpad(CAST(pos DIV 100 AS STRING), 9, '0') AS ts",
    )
    assert log.schema.names == schemas.FEEDBACK.names
    overrides = feedback.latest_overrides(log)
    plan = plan_of(overrides)
    assert "partial_max_by" in plan
    last = max(range(0, ROWS, 3), key=lambda i: (i // 100, str(i)))
    assert overrides.filter("doc_id = 'hot'").first().override == f"w{last}"


def test_entities_of_a_hot_document(spark, rows):
    table = rows.selectExpr(
        "doc_id", "pos", "text AS Text", "CASE WHEN pos = 59997 THEN 'PERSON' ELSE 'DATE' END AS Type", "0.5D AS Score"
    )
    hot = entities.grouped_entities(table).filter("doc_id = 'hot'").first()
    assert len(hot.entities) == 50 and hot.person == "w59997"


def test_broadcast_only_when_measured_small(spark):
    def hinted(frame):
        return "ResolvedHint" in frame._jdf.queryExecution().analyzed().toString()

    table = spark.range(100).selectExpr("id", "repeat('x', 1000) AS label")
    assert hinted(broadcast_if_small(table))
    assert not hinted(broadcast_if_small(table, max_rows=99))
    assert not hinted(broadcast_if_small(table, max_bytes=100_000))


def test_hot_file_path(spark):
    events = spark.range(ROWS).selectExpr("CAST(id AS STRING) AS doc_id", f"'/raw/' || {KEY} AS file_path")
    files = events.select(F.col("file_path").alias("path")).distinct().withColumn("length", F.lit(1).cast("bigint"))
    checked = with_files(events, files.filter("path <> '/raw/k1'"))
    assert checked.count() == ROWS
    assert checked.filter("reason IS NOT NULL").select("file_path").distinct().count() == 1
