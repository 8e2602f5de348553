"""An archive of records, one JSON file each, as a data source to write to from batches and streams, and to read.

    df.write.format("record_archive").option("key", "event_id").mode("append").save(path)
    spark.read.format("record_archive").load(path)

A record's file has the name of its key, so the same record written again
replaces its file. Tasks write under `_pending`, each into a folder of its own,
and the commit moves whole files to their names; a task or batch that fails leaves
nothing that readers see, as they pass over names that begin with `_`. The path is any that pyarrow's
file systems open, on a cluster one that all its machines reach.

With the option `buckets` the files lie in that many folders, by a hash of their
names. Reading, with the same number, gives each record's JSON text; tasks list
the folders, so the driver, which never knows the files, needn't hold millions of
names as it must for `spark.read.json`.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


#: Most files of a task's folder, which the commit lists at once, and most folders that a task reads.
LOT, FOLDERS = 10_000, 8


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Pending(WriterCommitMessage):
    """Folder of a task's files that wait for the commit, in lots of LOT files."""

    folder: str
    records: int


def _place(options: dict[str, str]) -> tuple[str, int]:
    """Path and number of buckets."""
    path = options["path"]
    return path.removeprefix("file:") if path.startswith("file:/") else path, int(options.get("buckets", "0"))


class _Records:
    """Both phases, for batches and streams."""

    def __init__(self, options: dict[str, str]):
        (self.path, self.buckets), self.key = _place(options), options.get("key", "event_id")

    def place(self, root: str, name: str) -> str:
        return f"{root}/{zlib.crc32(name.encode()) % self.buckets:05d}/{name}" if self.buckets else f"{root}/{name}"

    def write(self, rows: Iterator[Row]) -> Pending:
        files, root = _files(self.path)
        folder, n = f"{root}/_pending/{uuid.uuid4().hex}", 0
        for row in rows:
            record = row.asDict(recursive=True)
            if record[self.key] is None:
                raise ValueError(f"a record has no {self.key}")
            if n % LOT == 0:
                files.create_dir(f"{folder}/{n // LOT:06d}", recursive=True)
            with files.open_output_stream(f"{folder}/{n // LOT:06d}/{quote(str(record[self.key]), safe='')}.json") as out:
                out.write(json.dumps(record, ensure_ascii=False, default=str).encode())
            n += 1
        return Pending(folder, n)

    def keep(self, messages: list[Pending | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        for bucket in range(self.buckets):
            files.create_dir(f"{root}/{bucket:05d}", recursive=True)
        with ThreadPoolExecutor(16) as pool:
            for message in filter(None, messages):
                # lot by lot: a later record of a key replaces an earlier one, and no more names than a lot's are held
                for lot in (f"{message.folder}/{i:06d}" for i in range(-(-message.records // LOT))):
                    found = [x.base_name for x in files.get_file_info(fs.FileSelector(lot))]
                    list(pool.map(lambda name, lot=lot: files.move(f"{lot}/{name}", self.place(root, name)), found))
                if message.records:
                    files.delete_dir(message.folder)

    def drop(self, messages: list[Pending | None]) -> None:
        files, _ = _files(self.path)
        for message in filter(None, messages):
            if message.records:
                files.delete_dir(message.folder)


class _BatchWriter(_Records, DataSourceWriter):
    def commit(self, messages: list[Pending | None]) -> None:
        self.keep(messages)

    def abort(self, messages: list[Pending | None]) -> None:
        self.drop(messages)


class _StreamWriter(_Records, DataSourceStreamWriter):
    def commit(self, messages: list[Pending | None], batchId: int) -> None:  # noqa: N803
        self.keep(messages)

    def abort(self, messages: list[Pending | None], batchId: int) -> None:  # noqa: N803
        self.drop(messages)


@dataclass
class Folders(InputPartition):
    """Folders that a task reads."""

    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.buckets = _place(options)

    def partitions(self) -> Sequence[Folders]:
        names = [f"/{bucket:05d}" for bucket in range(self.buckets)] or [""]
        return [Folders(tuple(names[i : i + FOLDERS])) for i in range(0, len(names), FOLDERS)]

    def read(self, partition: Folders) -> Iterator[tuple[str]]:
        from pyarrow import fs

        files, root = _files(self.path)
        for name in partition.names:
            for found in files.get_file_info(fs.FileSelector(f"{root}{name}", allow_not_found=True)):
                if found.type == fs.FileType.File and not found.base_name.startswith("_"):
                    with files.open_input_stream(found.path) as record:
                        yield (record.read().decode(),)


class RecordArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_archive"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordArchive)
