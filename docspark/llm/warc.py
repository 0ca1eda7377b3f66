"""WARC archives written from, and read as, a table of chunks.

A payload never has to be in one piece: it is cut into rows of record, chunk
number and at most `CHUNK` bytes, each with the digest of all bytes up to its
end. The last chunk of a record so carries the size and digest of the whole
payload, and no row has to be grouped to know them.

Writing: of records with equal payloads one is the response, the others are
revisits of it. The response is found by digest in one aggregation that keeps one
payload per digest in every task; revisits are made without their payload. Chunks
of a record follow each other in a task, which writes them through one
compressor per record. Files get names of their own, and only those listed in the
returned manifest count: a repeated task leaves nothing in it.

Reading: a task walks through one archive, plain or with a gzip member per record.
It holds one header and one chunk.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import common

# --- fixed values ----------------------------------------------------------
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ---------------------------------------------------------------------------
CHUNK = 1 << 20
# A task starts a new archive after a record that takes the file over this size.
FILE_BYTES = 1 << 28
# Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
# Parts into which the rows of one digest are dealt.
SALTS = 64
# Copies of one row that a task makes at most.
REPEATS = 4096
LEVEL = 4
# Limits of what a header may hold, and of what is handed to Spark at a time.
MAX_HEADER = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096

_PRINTABLE = "".join(map(chr, range(33, 127)))
_MANIFEST = "file string, records long, bytes long"
_CHUNKS = (
    "file string, record_id string, record_key string, record_type string, target_uri string, refers_to string, "
    "refers_to_key string, declared_digest string, declared_bytes long, chunk int, end long, sha256 string, last boolean"
)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Spark names by `path`."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path if parts.scheme else path
    return fs.FileSystem.from_uri(f"s3{path[3:]}" if parts.scheme == "s3a" else path)


# --- from rows to records ----------------------------------------------------


def _age(key: str, url: str) -> Column:
    """Order in which records of one payload are taken: by key, a null one last, then by address."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(url).alias("url"))


def as_records(
    pages: DataFrame,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> DataFrame:
    """One row per record: `key`, `url`, `digest`, `bytes`, `type`, `refers_to` and `payload`, null for revisits.

    Every row of `pages` becomes one record. A null payload is an empty one. Of
    rows that are equal in key, address and payload one is the response; a null key
    is the response only if all are null. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key_col).alias("key"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    is_small = F.col("bytes") < min_revisit
    light = common.stored(rows.withColumn("payload", F.when(is_small, F.col("payload"))))

    order = _age("key", "url")
    responses = (
        rows.filter(~is_small)
        .groupBy("digest", "bytes")
        .agg(F.min(order).alias("first"), F.min_by("payload", order).alias("payload"))
        .select("first.key", "first.url", "digest", "bytes", "payload")
    )
    plain = light.filter(is_small).select("key", "url", "digest", "bytes", "payload")
    none = F.lit(None)
    whole = responses.unionByName(plain).select(
        "key", "url", "digest", "bytes", F.lit("response").alias("type"),
        none.cast(pages.schema[key_col].dataType).alias("refers_to"), "payload",
    )
    return whole.unionByName(_revisits(light.filter(~is_small)).withColumn("payload", none.cast("binary")))


def _revisits(rows: DataFrame) -> DataFrame:
    """All but the first row of every digest. A digest's rows are dealt over `SALTS` groups."""
    salt = F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")
    counted = rows.groupBy("key", "url", "digest", "bytes").agg(F.count("*").alias("n")).withColumn("salt", salt)
    parts = counted.groupBy("digest", "salt").agg(F.min(_age("key", "url")).alias("first"), F.sum("n").alias("n"))
    groups = parts.groupBy("digest").agg(
        F.min("first").alias("first"), F.sum("n").alias("all"), F.collect_list("salt").alias("salts")
    )
    several = groups.filter(F.col("all") > 1).select("digest", "first", F.explode("salts").alias("salt"))
    is_first = _age("key", "url").eqNullSafe(F.col("first"))
    later = counted.join(several, ["digest", "salt"]).withColumn("n", F.col("n") - is_first.cast("long"))
    block = F.lit(REPEATS).cast("long")
    return common.copied(later.filter("n > 0"), "n", block, ["digest", "salt"], dealt=True).select(
        "key", "url", "digest", "bytes", F.lit("revisit").alias("type"), F.col("first.key").alias("refers_to")
    )


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of record and chunk number; those of a record follow each other, an empty payload has one."""

    def piece(number: Column) -> Column:
        data = F.substring(F.col("payload"), number * chunk + 1, F.lit(chunk))
        return F.struct(number.alias("chunk"), data.alias("data"))

    payload_bytes = F.coalesce(F.octet_length("payload"), F.lit(0))
    last = F.greatest(F.ceil(payload_bytes / chunk).cast("int") - 1, F.lit(0))
    # The pieces are cut before they become rows: no row of a piece carries the payload.
    pieces = F.explode(F.transform(F.sequence(F.lit(0), last), piece)).alias("piece")
    kept = [c for c in records.columns if c != "payload"]
    return records.select(*kept, last.alias("last_chunk"), pieces).select(
        *kept, "last_chunk", "piece.chunk", F.coalesce("piece.data", F.lit(b"")).alias("data")
    )


# --- writing -----------------------------------------------------------------


def _uuid(data: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(data).digest()[:16], version=5)}>"


def _of_payload(digest: str) -> str:
    """Id of the response that holds a payload, known to its revisits by the digest."""
    return _uuid(b"payload " + digest.encode())


class _Archive:
    """One archive being written, a gzip member per record."""

    def __init__(self, filesystem: fs.FileSystem, path: str, name: str, date: str):
        self.name, self.date, self.records, self.size = name, date, 0, 0
        self.out = filesystem.open_output_stream(f"{path}/{name}", compression=None)
        self.begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _uuid(name.encode()))], b"format: WARC 1.1\r\n", 0)
        self.end()
        self.records = 0

    def begin(self, fields: list[tuple[str, str]], head: bytes, payload_bytes: int) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        length = ("Content-Length", str(len(head) + payload_bytes))
        lines = [VERSION, *(f"{k}: {v}" for k, v in [*fields, ("WARC-Date", self.date), length])]
        self.add("\r\n".join(lines).encode() + b"\r\n\r\n" + head)

    def add(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._put(self.member.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.size


def _fields(archive: _Archive, key: str | None, url: str | None, digest: str, kind: str, refers_to: str | None, is_holder: bool):
    name = lambda k: quote(k, safe=_PRINTABLE.replace("%", ""))
    own = _of_payload(digest) if is_holder else _uuid(f"{archive.name} {archive.records}".encode())
    yield "WARC-Type", kind
    yield "WARC-Record-ID", own
    yield "WARC-Target-URI", "urn:null" if url is None else quote(url, safe=_PRINTABLE)
    yield "WARC-Payload-Digest", f"sha256:{digest}"
    yield "Content-Type", "application/http; msgtype=response"
    if key is not None:
        yield "X-Record-Key", name(key)
    if kind == "revisit":
        yield "WARC-Profile", REVISIT_PROFILE
        yield "WARC-Refers-To", _of_payload(digest)
        if refers_to is not None:
            yield "X-Refers-To-Key", name(refers_to)


def write_archives(
    records: DataFrame,
    path: str,
    chunk: int = CHUNK,
    file_bytes: int = FILE_BYTES,
    min_revisit: int = MIN_REVISIT,
    content_type: str = "text/html; charset=utf-8",
) -> DataFrame:
    """Writes the rows of `as_records` to archives under `path` and returns their manifest.

    The manifest has `file`, `records` and `bytes`, one row per archive. It is written
    with the job: files of tasks that failed or ran twice are not in it. Without
    records there are no archives.
    """
    common.on_workers(records.sparkSession)
    rows = chunked(records.withColumns({c: F.col(c).cast("string") for c in ("key", "refers_to")}), chunk)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = ["key", "url", "digest", "bytes", "type", "refers_to", "last_chunk", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = open_folder(path)
        filesystem.create_dir(folder, recursive=True)
        archive, done = None, []
        for batch in batches:
            small = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
            data = batch.column(batch.schema.get_field_index("data"))
            for i, (key, url, digest, size, kind, refers_to, last, number) in enumerate(small):
                if number == 0:
                    if archive is not None and archive.size > file_bytes:
                        done.append(archive.close())
                        archive = None
                    archive = archive or _Archive(filesystem, folder, f"{uuid.uuid4().hex}.warc.gz", date)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {size}\r\n\r\n".encode()
                    is_holder = kind == "response" and size >= min_revisit
                    fields = list(_fields(archive, key, url, digest, kind, refers_to, is_holder))
                    archive.begin(fields, head, size if kind == "response" else 0)
                archive.add(data[i].as_py())
                if number == last:
                    archive.end()
        if archive is not None:
            done.append(archive.close())
        columns = [list(c) for c in zip(*done, strict=True)] or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["file", "records", "bytes"],
        )

    folder = F.concat(F.lit(path.rstrip("/") + "/"), F.col("file"))
    written = rows.select(*names, "data").mapInArrow(run, _MANIFEST)
    return common.stored(written.withColumn("file", folder))


# --- reading -----------------------------------------------------------------


def _fields_of(stream: io.BufferedReader, where: str, limit: int = MAX_HEADER) -> tuple[dict[str, str], int]:
    """Fields up to the empty line, their names in lower case, and the bytes read. Folded lines go on with a blank."""
    fields, name, read = {}, None, 0
    while True:
        line = stream.readline(limit - read + 1)
        read += len(line)
        if read > limit:
            raise ValueError(f"{where}: a header of more than {limit} bytes")
        if not line.endswith(b"\n"):
            raise ValueError(f"{where}: a header ends too early")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return fields, read
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()


class _Bounded(io.RawIOBase):
    """The next `length` bytes of a stream."""

    def __init__(self, stream: io.BufferedReader, length: int, where: str):
        self.stream, self.left, self.where = stream, length, where

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.stream.read(min(len(target), self.left))
        if not data and self.left:
            raise ValueError(f"{self.where}: a record ends too early")
        target[: len(data)] = data
        self.left -= len(data)
        return len(data)


def records_of(source, where: str, chunk: int = CHUNK) -> Iterator[tuple[tuple, int, int, bytes, str, bool]]:
    """Of every chunk in an open archive: header values, number, end in the payload, bytes, digest so far, if it is the last."""
    plain = io.BufferedReader(source, 1 << 16)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 16) if plain.peek(2)[:2] == b"\x1f\x8b" else plain
    while line := stream.readline(MAX_HEADER):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where}: no record where one should begin")
        fields, _ = _fields_of(stream, where)
        raw = _Bounded(stream, int(fields.get("content-length", 0)), where)
        block = io.BufferedReader(raw, 1 << 16)
        declared = None
        if fields.get("content-type", "").startswith("application/http") and raw.left:
            http, _ = _fields_of(block, where)
            declared = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        digest = fields.get("warc-payload-digest", "")
        key, refers_to = fields.get("x-record-key"), fields.get("x-refers-to-key")
        header = (
            fields.get("warc-record-id"), key and unquote(key), fields.get("warc-type"), fields.get("warc-target-uri"),
            fields.get("warc-refers-to"), refers_to and unquote(refers_to), digest.removeprefix("sha256:") or None, declared,
        )
        sha, number, end = hashlib.sha256(), 0, 0
        data = block.read(chunk)
        while True:
            following = block.read(chunk) if len(data) == chunk else b""
            sha.update(data)
            end += len(data)
            yield header, number, end, data, sha.copy().hexdigest(), not following
            if not following:
                break
            data, number = following, number + 1


def read_chunks(spark: SparkSession, archives: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives named in the column `file`.

    One row per chunk: the record's id, key, type and other header values, `chunk`
    from 0, `end` of the chunk in the payload, `sha256` of the payload up to there,
    whether it is the `last`, and its `data`, unless `payloads` is false. A record
    without payload has one empty chunk. An archive that is cut off is an error.
    """
    common.on_workers(spark)
    files = archives.select("file")
    # One task per archive; archives are of bounded size.
    tasks = max(1, files.count())
    schema = _CHUNKS + (", data binary" if payloads else "")
    names = [part.split()[0] for part in schema.split(", ")]
    integers = {"declared_bytes": pa.int64(), "chunk": pa.int32(), "end": pa.int64(), "last": pa.bool_(), "data": pa.binary()}
    types = [integers.get(n, pa.string()) for n in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                filesystem, path = open_folder(file)
                with filesystem.open_input_stream(path, compression=None) as source:
                    for header, number, end, data, sha, last in records_of(source, file, chunk):
                        rows.append((file, *header, number, end, sha, last, *([data] if payloads else [])))
                        size += len(data) if payloads else 0
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
        yield batch_of(rows)

    return files.repartition(tasks).mapInArrow(run, schema)


def records(chunks: DataFrame) -> DataFrame:
    """One row per response or revisit, from the last chunks alone.

    `payload_bytes` and `payload_digest` are those of the full payload: read for a
    response, declared for a revisit. `intact` is false where a response is not
    what its header says.
    """
    last = chunks.filter(F.col("last") & F.col("record_type").isin("response", "revisit"))
    is_revisit = F.col("record_type") == "revisit"
    return last.select(
        "file",
        "record_id",
        "record_key",
        "record_type",
        "target_uri",
        F.when(is_revisit, F.col("declared_bytes")).otherwise(F.col("end")).alias("payload_bytes"),
        F.when(is_revisit, F.col("declared_digest")).otherwise(F.col("sha256")).alias("payload_digest"),
        "refers_to",
        "refers_to_key",
        (is_revisit | F.col("declared_digest").eqNullSafe(F.col("sha256"))).alias("intact"),
    )


def archived(
    pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Writes all rows to archives under `path`, reads them back and returns `records` with keys of their own type.

    Nulls, repeated rows and other columns as in `as_records`; an empty table gives
    no rows. Texts of any length are archived whole.
    """
    manifest = write_archives(as_records(pages, key_col, url_col, payload_col), path)
    read = records(read_chunks(pages.sparkSession, manifest, payloads=False))
    kind = pages.schema[key_col].dataType
    return read.withColumns({c: F.col(c).cast(kind) for c in ("record_key", "refers_to_key")})
