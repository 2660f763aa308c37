"""A data source of image files: ``spark.read.format("weftline-images")`` and ``df.write.format("weftline-images")``.

Rows are files (name, data). Reading deals files out by their bytes. A write is whole or nothing: tasks write below a hidden
folder of the job, each attempt under names of its own, and only the commit, on the driver, moves what the successful attempts
wrote; if a file of one of the names is there (mode append) or two rows have one name, nothing is moved. An abort, and a
commit, remove the hidden folder, so that failed or repeated attempts leave nothing.

The folder (option ``path``) is on a file system that driver and executors mount, which moves a file in one step.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .images import EXTENSIONS

#: Bytes of files that one task reads, unless a file is larger.
PART = 32 << 20


def folder_of(options: dict) -> str:
    path = options.get("path") or ""
    url = urlparse(path)
    if not path or url.scheme not in ("", "file"):
        raise ValueError(f"image files need a mounted folder as path, not {path!r}")
    return unquote(url.path) if url.scheme else path


@dataclass
class Files(InputPartition):
    paths: list[str]


class ImageReader(DataSourceReader):
    def __init__(self, folder: str, part: int):
        self.folder, self.part = folder, part

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        left = 0
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if not entry.is_file() or entry.name.startswith((".", "_")) or entry.name.rpartition(".")[2].lower() not in EXTENSIONS:
                continue
            size = entry.stat().st_size
            if not out or size > left:
                out.append(Files([]))
                left = self.part
            out[-1].paths.append(entry.path)
            left -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as file:
                yield os.path.basename(path), file.read()


@dataclass
class Written(WriterCommitMessage):
    #: Name of each file and where the attempt has put it.
    files: list[tuple[str, str]]


class ImageWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.hidden = os.path.join(folder, f"_job-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        own = os.path.join(self.hidden, uuid.uuid4().hex)
        os.makedirs(own)
        files = []
        for i, row in enumerate(iterator):
            name = row["name"]
            if not name or name in (".", "..") or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a name for a file: {name!r}")
            at = os.path.join(own, str(i))
            with open(at, "wb") as file:
                file.write(row["data"] or b"")
            files.append((name, at))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        twice = [n for n, k in Counter(n for n, _ in files).items() if k > 1]
        if twice:
            raise ValueError(f"two files of one name: {sorted(twice)[:5]}")
        there = [] if self.overwrite else [n for n, _ in files if os.path.exists(os.path.join(self.folder, n))]
        if there:
            raise FileExistsError(f"{len(there)} files exist: {sorted(there)[:5]}")
        for name, at in files:
            os.replace(at, os.path.join(self.folder, name))
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline-images"

    def schema(self) -> str:
        return "name string, data binary"

    def reader(self, schema) -> ImageReader:
        return ImageReader(folder_of(self.options), int(self.options.get("part", PART)))

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(folder_of(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageFiles)
