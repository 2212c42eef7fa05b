"""Byte ranges of files for tasks, and files that tasks write under names of their own."""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import ArrowException
from pyarrow import fs as afs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: ``at(start, size)`` gives bytes of a file.
At = Callable[[int, int], bytes]


def open_store(path: str) -> tuple[afs.FileSystem, str] | None:
    """File system and path in it; None where only Spark's readers can open the store."""
    try:
        return afs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    except (ArrowException, OSError, ValueError):
        return None


def list_files(path: str, pattern: str = "*") -> list[str]:
    """Paths within the file system of a file, of the files of a folder, or of those that a pattern in the last part fits."""
    return sorted(list_sizes(path, pattern))


def list_sizes(path: str, pattern: str = "*") -> dict[str, int]:
    """The files of ``list_files`` with their bytes."""
    store, at = open_store(path)
    folder, _, last = at.rpartition("/")
    if re.search(r"[*?\[]", last):
        at, pattern = folder, last
    info = store.get_file_info(at)
    if info.type == afs.FileType.File:
        return {at: info.size}
    if info.type != afs.FileType.Directory:
        raise FileNotFoundError(path)
    return {f.path: f.size for f in store.get_file_info(afs.FileSelector(at)) if f.type == afs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), pattern.lower())}


def reader_at(file) -> At:
    def at(start: int, size: int) -> bytes:
        file.seek(start)
        return file.read(size)

    return at


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str] = field(default_factory=list)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.new = path, f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        own = Written(f"{self.new}/{uuid.uuid4().hex}")  # a folder for each attempt at a task
        store, at = open_store(own.folder)
        store.create_dir(at, recursive=True)
        for row in iterator:
            if "/" in row["name"]:
                raise ValueError(f"{row['name']!r} is not a file name")
            with store.open_output_stream(f"{at}/{row['name']}") as out:
                out.write(row["content"])
            own.names.append(row["name"])
        return own

    def commit(self, messages: list) -> None:
        store, target = open_store(self.path)
        for m in filter(None, messages):
            for name in m.names:
                store.move(f"{open_store(m.folder)[1]}/{name}", f"{target}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, at = open_store(self.new)
        if store.get_file_info(at).type == afs.FileType.Directory:
            store.delete_dir(at)


class NamedFiles(DataSource):
    """A sink that writes each row ``name, content`` as a file of a folder; files appear when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row ``name, content`` (text or binary) as a file of its own, where the row is, and tell how many there were.

    Tasks write their files; the driver gets their names and moves them to
    ``folder`` once all are there.  Of rows with one name the last wins.  The
    folder must be in a store that tasks can open (a shared disk, an object
    store or HDFS).
    """
    if open_store(folder) is None:
        raise ValueError(f"tasks can't write files to {folder}")
    spark, seen = files.sparkSession, Observation()
    spark.dataSource.register(NamedFiles)
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("named_files").mode("append").save(folder)
    return seen.get["n"]
