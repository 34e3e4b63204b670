"""Folders of text files, and files that hold one JSON array, as sources and sinks of Spark.

Both work on any store that ``pyarrow.fs`` opens by its URI; a path without scheme is a local or shared folder.  What a task
does not manage is undone: a writer's files appear under their names only when all tasks are done.

``TextFolder`` reads ``name, text, reason``: a row for each file, with the reason and no text where it cannot be read
or is no UTF-8.  Only names and sizes are listed before the job; the first files by name are chosen there, and files are grouped by
size, a partition for each group.  It writes ``name, text`` as files.

``JsonArray`` writes one column of JSON values as one array, in the order of the partitions and their rows.  Each task writes a part;
the commit joins the parts in pieces of a megabyte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

GROUP_BYTES = 32 << 20
GROUP_FILES = 4096
PIECE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Group(InputPartition):
    names: list[str]


@dataclass
class _Part(WriterCommitMessage):
    number: int
    files: list[str]


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.any_case = options.get("anycase", "false").lower() == "true"
        self.most = int(options["most"]) if "most" in options else None
        self.bytes, self.files = int(options.get("groupbytes", GROUP_BYTES)), int(options.get("groupfiles", GROUP_FILES))

    def partitions(self) -> list[_Group]:
        store, path = opened(self.path)
        if store.get_file_info(path).type != fs.FileType.Directory:
            raise FileNotFoundError(f"{self.path} is no folder")
        fits = (lambda n: n.lower().endswith(self.suffix.lower())) if self.any_case else (lambda n: n.endswith(self.suffix))
        found = sorted((f.base_name, f.size or 0) for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and fits(f.base_name))
        groups: list[_Group] = []
        size = 0
        for name, own in found[: self.most]:
            if not groups or size + own > self.bytes or len(groups[-1].names) >= self.files:
                groups.append(_Group([]))
                size = 0
            groups[-1].names.append(name)
            size += own
        return groups or [_Group([])]

    def read(self, partition: _Group) -> Iterator[tuple]:
        store, path = opened(self.path)
        for name in partition.names:
            try:
                with store.open_input_stream(f"{path}/{name}") as f:
                    text = f.readall().decode("utf-8")
            except (OSError, ValueError) as error:
                yield name, None, f"{name} cannot be read: {str(error).splitlines()[0] if str(error) else type(error).__name__}"
            else:
                yield name, text, None


class _FolderWriter(DataSourceArrowWriter):
    """Files are written under other names in a folder beside the target, and moved when all are there."""

    def __init__(self, options: dict) -> None:
        self.path, self.mark = options["path"].rstrip("/"), uuid.uuid4().hex

    def _own(self) -> tuple[fs.FileSystem, str, str]:
        store, path = opened(self.path)
        return store, path, f"{path}.writing-{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        store, _, beside = self._own()
        number = TaskContext.get().partitionId()
        own = f"{beside}/{number}-{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names = []
        for batch in iterator:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist()):
                if not name or "/" in name:
                    raise ValueError(f"{name!r} is no file name")
                with store.open_output_stream(f"{own}/{name}") as f:
                    f.write((text or "").encode())
                names.append(name)
        return _Part(number, [own])

    def commit(self, messages: list[_Part | None]) -> None:
        """The tasks' folders become one; of equal names one stays."""
        store, path, beside = self._own()
        store.create_dir(path, recursive=True)
        for m in messages:
            for own in m.files if m else ():
                for f in store.get_file_info(fs.FileSelector(own)):
                    store.move(f.path, f"{path}/{f.base_name}")
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        store, _, beside = self._own()
        if store.get_file_info(beside).type == fs.FileType.Directory:
            store.delete_dir(beside)


class TextFolder(DataSource):
    """Options: ``path``, ``suffix``, ``anycase``, ``most``, ``groupbytes``, ``groupfiles``."""

    @classmethod
    def name(cls) -> str:
        return "glyphflow.textfolder"

    def schema(self) -> str:
        return "name string, text string, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FolderReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _FolderWriter(dict(self.options))


class _ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, column: str) -> None:
        self.path, self.column, self.mark = options["path"].rstrip("/"), column, uuid.uuid4().hex

    def _own(self) -> tuple[fs.FileSystem, str, str]:
        store, path = opened(self.path)
        return store, path, f"{path}.writing-{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        store, _, beside = self._own()
        number = TaskContext.get().partitionId()
        part, some = f"{beside}/{number:08d}-{uuid.uuid4().hex}", False
        store.create_dir(beside, recursive=True)
        with store.open_output_stream(part) as f:
            for batch in iterator:
                for value in batch[self.column].to_pylist():
                    f.write(((",\n" if some else "") + ("null" if value is None else value)).encode())
                    some = True
        return _Part(number, [part] if some else [])

    def commit(self, messages: list[_Part | None]) -> None:
        store, path, beside = self._own()
        folder = path.rpartition("/")[0]
        if folder:
            store.create_dir(folder, recursive=True)
        store.create_dir(beside, recursive=True)
        whole = f"{beside}/whole"
        with store.open_output_stream(whole) as out:
            out.write(b"[")
            for k, part in enumerate(p for m in sorted((m for m in messages if m), key=lambda m: m.number) for p in m.files):
                out.write(b",\n" if k else b"\n")
                with store.open_input_stream(part) as f:
                    while piece := f.read(PIECE):
                        out.write(piece)
            out.write(b"\n]\n")
        store.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        store, _, beside = self._own()
        if store.get_file_info(beside).type == fs.FileType.Directory:
            store.delete_dir(beside)


class JsonArray(DataSource):
    """Option: ``path``.  The frame has one column of JSON texts."""

    @classmethod
    def name(cls) -> str:
        return "glyphflow.jsonarray"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        (column,) = schema.fieldNames()
        return _ArrayWriter(dict(self.options), column)


def read_folder(spark: SparkSession, path: str, suffix: str = "", any_case: bool = False, most: int | None = None) -> DataFrame:
    """``name, text, reason`` of the files of a folder whose names end in ``suffix``, or of the first ``most`` of them by name."""
    spark.dataSource.register(TextFolder)
    reader = spark.read.format(TextFolder.name()).option("suffix", suffix).option("anycase", any_case)
    return (reader if most is None else reader.option("most", most)).load(path)


def write_folder(files: DataFrame, path: str) -> None:
    """A file for each row of ``name, text``; a null text is an empty file."""
    files.sparkSession.dataSource.register(TextFolder)
    files.select("name", "text").write.format(TextFolder.name()).mode("append").save(path)


def write_array(values: DataFrame, path: str) -> None:
    """One JSON array of the texts of the one column of ``values``, in order."""
    values.sparkSession.dataSource.register(JsonArray)
    values.write.format(JsonArray.name()).mode("append").save(path)
