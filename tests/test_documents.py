from __future__ import annotations

import json
import random

import pytest
import rules
from pyspark.sql import functions as F

from docspark.functions import patterns, pyjson
from docspark.functions.text import first_line, non_blank_lines, strip, truncate_utf8
from docspark.operators import entities as E
from docspark.operators import fields, ocr
from docspark.operators.doctype import keyword_scores, with_doc_type
from docspark.operators.fields import with_fields
from docspark.operators.payload import fields_json, payload_json
from docspark.plans import corpora
from docspark.plans.catalog import reading
from docspark.plans.process import DocumentTables, documents, process
from docspark.sources import store

RESUME = (
    "Jane Roe\njane.roe@mail.example.com.\n+1 (415) 555-0100\nExperience\nSkills:\nPython, C++\nSQL"
)
INVOICE = "INVOICE\nInvoice #: INV-77\nBill to: ACME\nSubtotal $1,000.00\nTotal USD 1,200.50"
# (text, hint, type, confidence, some fields)
EDGES = [
    (
        RESUME,
        None,
        "resume",
        0.7,
        {
            "name": "Jane Roe",
            "email": "jane.roe@mail.example.com.",
            "phone": ["+1 (415) 555-0100"],
            "skills": ["Skills", "Python", "C++\nSQL"],
        },
    ),
    (
        INVOICE,
        None,
        "invoice",
        0.85,
        {"invoice_number": "INV-77", "total": "USD 1,200.50", "vendor_email": None},
    ),
    (
        "Invoice total due: USD 10, note: Invoice No. A-1",
        None,
        "invoice",
        0.7,
        {"invoice_number": "te", "total": "USD 10,"},
    ),
    (
        "Passport No: X1234567\nDate of birth: 01/02/1990\nNational ID",
        None,
        "kyc",
        0.85,
        {"date_of_birth": "01/02/1990", "document_id": None},
    ),
    (
        "Passport # X1234567\nDOB 01/02/1990",
        None,
        "kyc",
        0.55,
        {"date_of_birth": "01/02/1990", "document_id": "X1234567"},
    ),
    ("national id number 99", None, "kyc", 0.55, {"document_id": "number"}),
    ("identity card", None, "kyc", 0.55, {"document_id": "entity"}),
    ("a private note for another day", None, "invoice", 0.55, {"invoice_number": "te"}),
    ("resume and invoice", None, "resume", 0.55, {"name": "resume and invoice", "phone": []}),
    (
        "skills: Go, R, SQL\nskills",
        None,
        "resume",
        0.55,
        {"name": "skills: Go, R, SQL", "skills": ["skills", "SQL\nskills"]},
    ),
    ("hello world", None, "unknown", 0.3, {"raw_preview": "hello world"}),
    ("hello world", "contract", "contract", 0.3, {"raw_preview": "hello world"}),
    ("hello world", "Resume", "Resume", 0.3, {"raw_preview": "hello world"}),
    ("hello world", "invoice", "invoice", 0.3, {"invoice_number": None, "total": None}),
    ("", None, "unknown", 0.3, {"raw_preview": ""}),
    ("  \n ", "resume", "resume", 0.3, {"name": None, "phone": [], "skills": None}),
]

UNICODE = [
    "tél +33 6 12 34 56 78 resume",
    "resume ١٢٣٤٥٦٧٨٩٠١",
    "PAſSPORT# KXİı0ſ passport",
    "İnvoice # KA-İ total",
    "invoıce# x9 vat",
    "skills \x1cC#\x85Go lang\x0bR stats\x1eJava  script",
    "\x1f　 name here 　\x1f\r\nresume skills \x1d x",
    "born: ١/٢/1990 kyc",
    "total £ ٣,٤.5 EUR 12. $",
    "emoji \U0001f600 café \"quoted\" back\\slash \x7f \x00 tab\t ",
    "a" * 30000 + " total invoice",
    "x@y invoice a@b.c-.- total",
    ("5" + " " * 200 + "x ") * 3 + "resume",
    "no  :  \n : 77-A vat",
    "dob 1/2/90 dob 11/12/1990 kyc",
    "$5 $6.70.8 invoice USD\n9",
    "MIXED Skill set\n\nskills a b c d e f g h i j k l m n o p q r s t u v w x y z " + "go, " * 60,
]


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    pieces = [
        "invoice", "Invoice #", "no.", "id", "passport", "DOB", "born:", "skills", "Skill", "vat",
        "resume", "total", "USD", "$", "£", "12/03/1999", "1,200.50", "a.b@c.example", "@",
        "+1 (415) 555-0100", "0049 30 1234567", "\n", "\r\n", "\x85", " ", " ", " ", "\t",
        "X1234567", "#", ":", "-", "C++", "é", "中", "\U0001f600", "\x1c", ".", ",",
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def extract(spark, rows):
    frame = spark.createDataFrame(
        [(i, text, hint) for i, (text, hint) in enumerate(rows)], "i INT, text STRING, hint STRING"
    )
    out = with_fields(with_doc_type(frame)).select(
        "i",
        "doc_type",
        "confidence",
        fields_json(F.col("doc_type"), F.col("fields")).alias("fields"),
    )
    return [row.asDict() for row in out.orderBy("i").collect()]


def test_edge_rows(spark):
    got = extract(spark, [(text, hint) for text, hint, *_ in EDGES])
    for row, (text, _, doc_type, confidence, some) in zip(got, EDGES, strict=True):
        assert (row["doc_type"], row["confidence"]) == (doc_type, confidence), text
        values = json.loads(row["fields"])
        assert {name: values[name] for name in some} == some, text


def found(frame, *expressions):
    return [tuple(row) for row in frame.select("text", *expressions).collect()]


def test_each_pattern_alone(spark, sf_dir):
    """Every pattern against its plain value, on Unicode, random text and documents."""
    t = F.col("text")
    documents = corpora.read(spark, sf_dir, "documents").select("text")
    made = [(x,) for x in [e[0] for e in EDGES] + UNICODE + random_texts(600)]
    frame = spark.createDataFrame(made, "text STRING").union(documents)
    single = {
        rules.EMAIL: fields.email(t),
        rules.INVOICE_NUMBER: fields.invoice_number(t),
        rules.BIRTH_DATE: fields.birth_date(t),
        rules.DOCUMENT_ID: fields.document_id(t),
    }
    for text, *got in found(frame, *single.values()):
        for pattern, value in zip(single, got, strict=True):
            match = pattern.search(text)
            assert value == (match and match[pattern.groups]), (pattern.pattern, text)
    repeated = {rules.PHONE: patterns.PHONE, rules.AMOUNT: patterns.AMOUNT, rules.SKILL: patterns.SKILL}
    everywhere = [F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in repeated.values()]
    for text, *got in found(frame, *everywhere):
        for pattern, values in zip(repeated, got, strict=True):
            assert values == pattern.findall(text), (pattern.pattern, text)


def test_keywords_alone(spark, sf_dir):
    documents = corpora.read(spark, sf_dir, "documents").select("text")
    made = [(x,) for x in [e[0] for e in EDGES] + UNICODE + random_texts(600)]
    frame = spark.createDataFrame(made, "text STRING").union(documents)
    for text, scores in found(frame, keyword_scores(F.col("text"))):
        for doc_type, words in rules.KEYWORDS.items():
            assert scores[doc_type] == [word in text.lower() for word in words].count(True)


def test_strip_and_lines(spark):
    texts = UNICODE + random_texts(300)
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    t = F.col("t")
    rows = frame.select("t", strip(t), non_blank_lines(t), first_line(t)).collect()
    for text, stripped, lines, first in rows:
        expected = [line.strip() for line in text.splitlines() if line.strip()]
        assert stripped == text.strip()
        assert lines == expected
        assert first == next(iter(expected), None)


@pytest.mark.parametrize("tail", ["", "a", "é", "€", "\U0001f600", "�", "€x"])
def test_truncation_at_every_offset(spark, tail):
    texts = ["a" * n + tail * 3 for n in range(4485, 4503)] + ["€" * 1501, "\U0001f600" * 1126]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for text, cut in frame.select("t", truncate_utf8(F.col("t"))).collect():
        assert cut == text.encode()[:4500].decode(errors="ignore")


def test_json_text(spark):
    strings = [None, "", *UNICODE, *random_texts(200)]
    frame = spark.createDataFrame([(s, [s, "x"]) for s in strings], "s STRING, a ARRAY<STRING>")
    types = {f.name: f.dataType for f in frame.schema}
    columns = [pyjson.dumps(F.col(n), types[n]) for n in ("s", "a")]
    for s, a, text, array in frame.select("s", "a", *columns).collect():
        assert text == json.dumps(s)
        assert array == json.dumps(a)


def test_json_numbers(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, 0.1, 0.98, 1e-4, 1.5e-4, 9.999e-4, 1e-3, 5e-5, 1.25e-7, 123456.789, -2e-4]
    values += [round(rng.random(), 4) for _ in range(300)] + [rng.random() / 1e4 for _ in range(50)]
    frame = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for value, text in frame.select("v", pyjson.float_text(F.col("v"))).collect():
        assert text == json.dumps(value)


def test_whole_pages_and_answers_give_what_their_rows_give(spark, sf_dir):
    """One row per page or answer, cut where it stands, against a row per block or entity."""
    words, lines = corpora.ocr_word_arrays(spark, sf_dir), corpora.ocr_result_pages(spark, sf_dir)
    by_row = ocr.layout_summary(ocr.clean_words(ocr.words_from_arrays(words)), ["page", "pos"])
    whole = ocr.layout_of_pages(ocr.word_pages(words))
    assert whole.exceptAll(by_row.select(*whole.columns)).isEmpty() and whole.count() == by_row.count()
    by_row = ocr.layout_summary(ocr.clean_lines(ocr.blocks_from_results(lines)), ["result_no", "pos"])
    whole = ocr.layout_of_pages(ocr.line_pages(lines))
    assert whole.exceptAll(by_row.select(*whole.columns)).isEmpty() and whole.count() == by_row.count()

    by_row = ocr.layout_boxes(ocr.clean_words(ocr.words_from_arrays(words))).drop("pos")
    whole = ocr.boxes_of_pages(words)
    assert whole.exceptAll(by_row.select(*whole.columns)).isEmpty() and whole.count() == by_row.count()

    answers, phrases = corpora.entity_responses(spark, sf_dir), corpora.key_phrase_responses(spark, sf_dir)
    by_row = E.grouped_entities(corpora.exploded(answers))
    whole = E.answered_entities(answers)
    assert whole.exceptAll(by_row.select(*whole.columns)).isEmpty() and whole.count() == by_row.count()
    by_row = E.grouped_key_phrases(corpora.exploded(phrases))
    whole = E.answered_key_phrases(phrases)
    assert whole.exceptAll(by_row).isEmpty() and whole.count() == by_row.count()


def test_an_answer_that_came_twice_counts_once(spark):
    schema = "doc_id STRING, response ARRAY<STRUCT<Text: STRING, Type: STRING, Score: DOUBLE>>"
    rows = [("a", [("x", "PERSON", 0.5)]), ("a", [("x", "PERSON", 0.5)]), ("b", []), ("c", None)]
    got = E.answered_entities(spark.createDataFrame(rows, schema)).collect()
    assert [(r.doc_id, len(r.entities), r.person) for r in got] == [("a", 1, "x")]


def test_payloads_scan_each_input_once(spark, sf_dir):
    plan = reading.payloads(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 7


def shuffled_bytes(df) -> int:
    """Bytes of the rows that went through the shuffles of a plan that has run, before compression."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("dataSize").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_answers_are_cut_before_they_are_shuffled(spark):
    kinds = ["DATE", "PERSON", "ORGANIZATION"]
    rows = [(f"d{d}", [(f"name {i}", kinds[i % 3], 0.5) for i in range(5000)]) for d in range(4)]
    answers = spark.createDataFrame(rows, "doc_id STRING, response ARRAY<STRUCT<Text: STRING, Type: STRING, Score: DOUBLE>>")
    phrases = answers.select("doc_id", F.transform("response", lambda e: F.struct(e["Text"].alias("Text"), e["Score"].alias("Score"))).alias("response"))
    entities, key_phrases = E.answered_entities(answers), E.answered_key_phrases(phrases)
    assert shuffled_bytes(entities) < 50_000 and shuffled_bytes(key_phrases) < 50_000
    assert [(len(r.entities), r.person, r.entity_organization) for r in entities.collect()] == [(50, "name 1", "name 2")] * 4
    assert [len(r.key_phrases) for r in key_phrases.collect()] == [30] * 4


def test_of_several_answers_the_greatest_whole_one_counts(spark):
    """Answers that agree in the entities kept differ behind them, in length and in who is named first."""
    rng = random.Random(11)
    schema = "doc_id STRING, response ARRAY<STRUCT<Text: STRING, Type: STRING, Score: DOUBLE>>"
    rows = []
    for d in range(60):
        head = [("h", "PERSON" if d % 4 == 1 and i == 7 else "DATE", 0.0) for i in range(rng.choice([0, 3, 50, 55]))]
        for _ in range(4):
            tail = [(rng.choice(["", "a", "b"]), rng.choice(["DATE", "PERSON", "ORGANIZATION"]), 0.5) for _ in range(rng.randrange(6))]
            rows.append((f"d{d}", head + tail))
    got = {r.doc_id: r for r in E.answered_entities(spark.createDataFrame(rows, schema)).collect()}
    for doc_id in {row[0] for row in rows}:
        greatest = max(response for key, response in rows if key == doc_id)
        if not greatest:
            assert doc_id not in got
            continue
        found = got[doc_id]
        names = {kind: next((t for t, k, _ in greatest if k == kind and t), None) for kind in ("PERSON", "ORGANIZATION")}
        assert [tuple(e) for e in found.entities] == greatest[:50]
        assert (found.person, found.entity_organization) == (names["PERSON"], names["ORGANIZATION"])


def test_blocks_of_pages_are_shuffled_by_columns(spark):
    arrays = ", ".join(f"{name} ARRAY<INT>" for name in ("left", "top", "width", "height"))
    rows = [(f"d{d}", page, ["word"] * 50, ["90.5"] * 50, *([[7] * 50] * 4)) for d in range(5) for page in range(20)]
    rows.append(("d0", 3, ["other"] * 3, ["80.5"] * 3, *([[1] * 3] * 4)))
    pages = spark.createDataFrame(rows, f"doc_id STRING, page INT, text ARRAY<STRING>, conf ARRAY<STRING>, {arrays}")
    layout = ocr.layout_of_pages(ocr.word_pages(pages))
    assert shuffled_bytes(layout) < 100 * 40 * 90
    assert sorted((r.doc_id, r.line_count, len(r.layout_lines)) for r in layout.collect()) == [("d0", 1003, 40), *((f"d{d}", 1000, 40) for d in range(1, 5))]


def test_processed_json_files_are_compressed(spark, tmp_path):
    texts = spark.createDataFrame([(f"d{i}", "Invoice # 7\nTotal USD 5", None) for i in range(50)], "doc_id STRING, text STRING, hint STRING")
    events = reading.upload_events(texts)
    rows = process(events, documents(DocumentTables(texts.drop("hint"))))
    store.write_processed_json(rows, f"{tmp_path}/json")
    parts = [p.name for p in (tmp_path / "json").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.endswith(".txt.gz") for p in parts)
    read = store.read_processed_json(spark, f"{tmp_path}/json", glob="*", whole_files=False).select(payload_json().alias("p"))
    assert read.count() == 50 and read.exceptAll(rows.select(payload_json().alias("p"))).isEmpty()
