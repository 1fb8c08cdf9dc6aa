"""A data source that writes files: ``df.write.format("blobs").mode("append").save(root)`` for rows of a path and content."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Moves that a commit makes side by side.
MOVES = 32
#: Age of what stopped jobs left, in which no job writes any more.
STALE = timedelta(days=2)


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")


@dataclass
class Staged(WriterCommitMessage):
    """A task's list of staged files and their places, and how many files were there already."""

    list_: str
    files: int
    kept: int


class BlobWriter(DataSourceArrowWriter):
    """Tasks write files beside the tree; only when all are done does a commit move them to their places.

    A job that fails leaves no file at any place, and of a task that ran twice only the files of one run are moved. What
    tasks still write while their job is stopped lies in a hidden folder, which a commit removes once it is ``STALE`` old. A file
    of the same size at its place stays as it is: names are made of contents. Paths that lead out of the tree are errors.
    """

    def __init__(self, root: str, path: int, content: int):
        self.root, self.path, self.content = root, path, content
        self.stage = f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = file_system(self.root)
        own, lines, kept = f"{base}/{self.stage}/{uuid.uuid4().hex}", [], 0
        fs.create_dir(own, recursive=True)
        for batch in iterator:
            for at in range(batch.num_rows):
                name, data = batch.column(self.path)[at].as_py(), batch.column(self.content)[at].as_py() or b""
                if not name or name.startswith("/") or ".." in name.split("/") or "\n" in name:
                    raise ValueError(f"not a path inside: {name}")
                there = fs.get_file_info(f"{base}/{name}")
                if there.type == pafs.FileType.File and there.size == len(data):
                    kept += 1
                    continue
                with fs.open_output_stream(f"{own}/{len(lines)}") as f:
                    f.write(data)
                lines.append(name)
        with fs.open_output_stream(f"{own}/list") as f:
            f.write("\n".join(lines).encode())
        return Staged(own, len(lines), kept)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, base = file_system(self.root)

        def move(job: tuple[str, str]) -> None:
            fs.create_dir(f"{base}/{job[1]}".rsplit("/", 1)[0], recursive=True)
            fs.move(job[0], f"{base}/{job[1]}")

        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is not None and m.files:
                    with fs.open_input_stream(f"{m.list_}/list") as f:
                        names = f.read().decode().split("\n")
                    list(pool.map(move, [(f"{m.list_}/{i}", n) for i, n in enumerate(names)]))
        self._clear(fs, base)
        for old in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if old.base_name.startswith(".staged-") and old.mtime and datetime.now(UTC) - old.mtime > STALE:
                fs.delete_dir(old.path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*file_system(self.root))

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        if fs.get_file_info(f"{base}/{self.stage}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.stage}")


class Blobs(DataSource):
    """Options: path (the root), name and content (columns, ``storage_path`` and ``content`` unless given)."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        if overwrite:
            raise ValueError("files are added only: mode('append')")
        at = schema.fieldNames().index
        return BlobWriter(self.options["path"], at(self.options.get("name", "storage_path")), at(self.options.get("content", "content")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Blobs)
