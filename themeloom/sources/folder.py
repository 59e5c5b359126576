"""Folders of text files as a data source: ``spark.read.format("text_folder")`` and ``df.write``.

The reader plans its tasks from the file listing (names and lengths): files in the order of their
names, cut into runs of about equal cost. A run knows the number of its first file, so that
documents are numbered 0, 1, 2, … while they are read, with no sort, join or second reading, and
files of no length are documents like any other. The listing is held by the driver, as that of any
file source is; a text is held by one task at a time.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "doc_id bigint, name string, value string"
SPLIT_BYTES = 128 << 20  # cost of a task's files at most, but for a longer file alone
OPEN_BYTES = 1 << 14  # opening a file costs as much as reading so many bytes
BATCH_BYTES = 8 << 20


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def reachable(folder: str) -> bool:
    """Whether Python tasks can read the folder; some stores are open to Spark's own readers only."""
    try:
        at, path = store(folder)
        return at.get_file_info(path).type == fs.FileType.Directory
    except (pa.ArrowInvalid, OSError, ImportError):
        return False


@dataclass
class Run(InputPartition):
    """Files of one task: the number of the first one, and their paths in the order of their names."""

    first: int
    paths: list[str]


def globs(pattern: str) -> list[str]:
    """The pattern as Spark's readers know it, ``{a,b}`` and ``[^a]`` too, in ``fnmatch``'s terms."""
    choice = re.search(r"\{([^{}]*)\}", pattern)
    if not choice:
        return [pattern.replace("[^", "[!")]
    return [g for one in choice[1].split(",") for g in globs(pattern[: choice.start()] + one + pattern[choice.end() :])]


def listing(folder: str, pattern: str, keep_empty: bool = True) -> list[tuple[str, int]]:
    """``(path, length)`` of the files right in the folder, by name; hidden ones and folders are left out."""
    at, path = store(folder)
    wanted = globs(pattern)
    files = [
        (info.base_name, info.path, info.size)
        for info in at.get_file_info(fs.FileSelector(path))
        if info.is_file and info.base_name[0] not in "._" and any(fnmatch.fnmatchcase(info.base_name, g) for g in wanted)
    ]
    return [(path, size) for _, path, size in sorted(files) if size or keep_empty]


def runs(files: list[tuple[str, int]], tasks: int) -> list[Run]:
    """The files in order, cut where a task has its share of the cost."""
    share = min(SPLIT_BYTES, sum(size + OPEN_BYTES for _, size in files) // tasks + 1)
    out, cost = [], 0
    for number, (path, size) in enumerate(files):
        if not out or cost + size + OPEN_BYTES > share and cost:
            out.append(Run(number, []))
            cost = 0
        out[-1].paths.append(path)
        cost += size + OPEN_BYTES
    return out or [Run(0, [])]


class TextFolder(DataSource):
    """``text_folder``: options ``path``, ``pattern``, ``keepempty`` and ``tasks`` (the least number of tasks)."""

    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options["path"])


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*")
        self.keep_empty = options.get("keepempty", "true").lower() == "true"
        self.tasks = int(options.get("tasks", "1"))

    def partitions(self) -> list[Run]:
        return runs(listing(self.folder, self.pattern, self.keep_empty), self.tasks)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        at, _ = store(self.folder)
        rows, held = [], 0
        for number, path in enumerate(partition.paths, partition.first):
            with at.open_input_stream(path) as file:
                raw = file.read()
            rows.append((number, path.rsplit("/", 1)[-1], raw.decode("utf-8", "replace")))
            held += len(raw) + 100
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "name", "value"])


class FolderWriter(DataSourceArrowWriter):
    """One file for each ``(name, value)``. A file appears whole, by a rename, so a task may run again.

    Tasks write in hidden folders of their own: in one folder they would wait for each other twice a file.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        at, path = store(self.folder)
        at.create_dir(path, recursive=True)
        own = f"{path}/_{uuid.uuid4().hex}"
        at.create_dir(own)
        unfinished = f"{own}/text"
        for batch in iterator:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                with at.open_output_stream(unfinished, compression=None) as file:
                    file.write((value or "").encode())
                at.move(unfinished, f"{path}/{name}")
        at.delete_dir(own)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, path = store(self.folder)
        at.create_dir(path, recursive=True)  # of no rows
