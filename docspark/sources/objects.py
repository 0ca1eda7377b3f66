"""One stored object per row, written by a sink with a commit in two phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from docspark.session import on_workers

FORMAT = "objects"
STAGING = "_staging"
# Renames at a time when a write is committed.
RENAMES = 32


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Spark names by ``uri``."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(f"s3{uri[3:]}" if parts.scheme == "s3a" else uri)


@dataclass
class Staged(WriterCommitMessage):
    """Folder of a finished task and the number of objects in it."""

    folder: str
    count: int


class ObjectWriter(DataSourceWriter):
    """Writes rows of (name, content): tasks to folders of their own, the commit moves them.

    Nothing is seen under its name before all tasks are done. What a failed, lost or
    repeated task has left stays in the staging folder of this write, which commit
    and abort delete. An object that is there already is replaced.
    """

    def __init__(self, directory: str):
        self.directory = directory.rstrip("/")
        self.staging = f"{self.directory}/{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        store, path = open_folder(folder)
        count = 0
        for row in iterator:
            if not count:
                store.create_dir(path, recursive=True)
            name, content = row["name"], row["content"]
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no name of an object")
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(b"" if content is None else bytes(content))
            count += 1
        return Staged(folder, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, target = open_folder(self.directory)
        store.create_dir(target, recursive=True)

        def promote(info: fs.FileInfo) -> None:
            store.move(info.path, f"{target}/{info.base_name}")

        # One rename per object of a write; a micro-batch is bounded by its trigger.
        with ThreadPoolExecutor(RENAMES) as pool:
            for message in messages:
                if message is not None and message.count:
                    _, path = open_folder(message.folder)
                    list(pool.map(promote, store.get_file_info(fs.FileSelector(path))))
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, path = open_folder(self.staging)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


class ObjectSource(DataSource):
    """Sink of format ``objects``; ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are added, a folder is not replaced")
        if schema.names != ["name", "content"]:
            raise ValueError(f"columns must be name and content, not {schema.names}")
        return ObjectWriter(self.options["path"])


def write_objects(rows: DataFrame, directory: str) -> None:
    """Writes one file per row of (name STRING, content BINARY) into a folder.

    Names must be distinct: of rows of one name, one is kept. An object costs its file
    more than its bytes, and many small ones come in few parts, so rows are dealt by
    name to as many tasks as shuffles have.
    """
    spark = rows.sparkSession
    on_workers(spark)
    spark.dataSource.register(ObjectSource)
    dealt = rows.select("name", "content").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    dealt.write.format(FORMAT).mode("append").save(directory)
