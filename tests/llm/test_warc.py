"""Archives written and read back against the rows they are made of."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark.llm import warc
from docspark.llm.queries import QUERIES
from odd_tables import PAGES, write

SCHEMA = "page_id bigint, url string, html string"


def plain(rows):
    """page_id, bytes, digest, type, refers_to of every row; a null id is larger than all."""
    order = lambda k: (k is None, k or 0)
    holders = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            holders[data] = min(holders.get(data, key), key, key=order)
    found, taken = Counter(), set()
    for key, _, html in rows:
        data = (html or "").encode()
        is_response = len(data) < 100 or (holders[data] == key and data not in taken)
        if len(data) >= 100 and is_response:
            taken.add(data)
        kind = ("response", None) if is_response else ("revisit", holders[data])
        found[(key, len(data), hashlib.sha256(data).hexdigest(), *kind)] += 1
    return found


def got(frame):
    names = ("record_key", "payload_bytes", "payload_digest", "record_type", "refers_to_key")
    rows = frame.collect()
    assert all(r.intact for r in rows)
    return Counter(tuple(r[n] for n in names) for r in rows)


def rows_of_all_kinds():
    rng = random.Random(11)
    texts = ["", None, "x" * 99, "x" * 100, "é" * 50, "é" * 49 + "x", "\r\n\r\nWARC/1.1\r\n" * 20, "long " * 5000]
    rows = [(i, f"http://h/{i} \r\n é", rng.choice(texts)) for i in range(900)]
    rows += [(1000 + i, None, "a page that many have, of more than a hundred bytes " * 3) for i in range(1500)]
    rows += [(3, "http://same", "a repeated row, written as often as it is there, " * 4)] * 400
    rows += [(None, "http://none", "x" * 100), (None, None, "only under null " * 20), (None, None, "only under null " * 20)]
    return rows


def test_records_are_the_rows(spark, tmp_path):
    rows = rows_of_all_kinds()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(warc.archived(frame, str(tmp_path / "a b é"))) == plain(rows)


def test_refers_to_is_the_id_of_the_response(spark, tmp_path):
    records = warc.archived(spark.createDataFrame(rows_of_all_kinds(), SCHEMA), str(tmp_path)).collect()
    ids = Counter(r.record_id for r in records)
    assert set(ids.values()) == {1}
    holders = {r.record_id: r for r in records if r.record_type == "response"}
    for r in records:
        if r.record_type == "revisit":
            holder = holders[r.refers_to]
            assert (holder.payload_digest, holder.record_key) == (r.payload_digest, r.refers_to_key)


def test_chunks_carry_the_digest_so_far(spark, tmp_path):
    data = bytes(random.Random(1).randrange(32, 127) for _ in range(10_000)).decode()
    frame = spark.createDataFrame([(1, "u", data), (2, "u", data[:4096]), (3, "u", "")], SCHEMA)
    manifest = warc.write_archives(warc.as_records(frame), str(tmp_path), chunk=1000)
    rows = warc.read_chunks(spark, manifest, chunk=2048).filter("record_key IS NOT NULL").collect()
    for key, text in (("1", data), ("2", data[:4096]), ("3", "")):
        chunks = sorted((r for r in rows if r.record_key == key), key=lambda r: r.chunk)
        assert [r.chunk for r in chunks] == list(range(max(1, -(-len(text) // 2048))))
        assert b"".join(bytes(r.data) for r in chunks).decode() == text
        assert [r.sha256 for r in chunks] == [hashlib.sha256(text[: r.end].encode()).hexdigest() for r in chunks]
        assert [r.last for r in chunks] == [False] * (len(chunks) - 1) + [True]


def test_payloads_are_the_stored_texts(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_archives(warc.as_records(pages), str(tmp_path), file_bytes=1000)
    assert manifest.count() > 8  # archives of bounded size
    chunks = warc.read_chunks(spark, manifest).filter("record_type = 'response'")
    texts = chunks.groupBy(F.col("record_key").cast("long").alias("page_id")).agg(F.first("data").cast("string").alias("html"))
    assert texts.exceptAll(pages.select("page_id", "html")).isEmpty()
    assert texts.count() == pages.count()


def test_archives_are_plain_warc(spark, tmp_path):
    """Read without the operator: a gzip member per record, headers and lengths that fit."""
    frame = spark.createDataFrame([(i, "http://a", "text " * (50 + i % 2)) for i in range(6)], SCHEMA)
    manifest = warc.write_archives(warc.as_records(frame), str(tmp_path)).collect()
    kinds = Counter()
    for row in manifest:
        whole = gzip.decompress(Path(row.file).read_bytes())
        while whole:
            head, rest = whole.split(b"\r\n\r\n", 1)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block, whole = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert whole.startswith(b"\r\n\r\n")
            whole = whole[4:]
            kinds[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                body = block.split(b"\r\n\r\n", 1)[1]
                assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
    assert (kinds["response"], kinds["revisit"]) == (2, 4)


def test_archives_of_others_are_read(tmp_path):
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<p>body</p>"
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID:<urn:1>\r\nContent-Type: application/http;\r\n msgtype=response\r\n"
    plain_file = record + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = list(warc.records_of(io.BytesIO(plain_file + other), "x"))
    assert [(r[0][0], r[0][2], r[3]) for r in rows] == [("<urn:1>", "response", b"<p>body</p>"), (None, "resource", b"abc")]
    with pytest.raises(ValueError, match="too early"):
        list(warc.records_of(io.BytesIO(plain_file[:-20]), "x"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.records_of(io.BytesIO(b"something\n"), "x"))


def test_changed_payload_is_not_intact(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a", "an old text " * 20)], SCHEMA)
    file = warc.write_archives(warc.as_records(frame), str(tmp_path)).first().file
    data = gzip.decompress(Path(file).read_bytes()).replace(b"an old text", b"a new texts")
    Path(f"{file}.changed").write_bytes(gzip.compress(data))
    archives = spark.createDataFrame([(f"{file}.changed",)], "file string")
    assert [r.intact for r in warc.records(warc.read_chunks(spark, archives)).collect()] == [False]


def test_odd_pages(spark, tmp_path):
    rows = QUERIES["op11_warc_chunks"](spark, write(tmp_path / "odd")).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in rows) == plain(PAGES)
