"""A data source of image folders: spark.read and write with format("image_folder").

Reading plans a partition for every few files of a folder (recursively, in order
of their names) and decodes each by its content. Writing encodes a row into a
file named by its path, by that name's ending. A task writes below a folder of
its own attempt; only files of attempts that the driver commits are moved into
place, so a task that runs twice leaves each file once and a failed write leaves
none. A name that exists is replaced.

Rows have the columns of codecs.SCHEMA; reading sets path to the name below the
folder. Other files of the folder, hidden ones and those whose first bytes no
reader knows, are refused with an error of the decoder.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.sources import codecs

NAME, TEMPORARY = "image_folder", "_temporary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return fs, root.rstrip("/")


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("filesPerPartition", "64"))

    def partitions(self) -> list[Files]:
        fs, root = opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        names = sorted(f.path[len(root) + 1 :] for f in found if f.is_file)
        names = [n for n in names if not any(part.startswith(("_", ".")) for part in n.split("/"))]
        return [Files(names[k : k + self.each]) for k in range(0, len(names), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, root = opened(self.path)
        columns = [c.split()[0] for c in codecs.SCHEMA.split(", ")]
        for name in partition.names:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                row = {"path": name} | codecs.decode(f.read())
            plain = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()}
            yield tuple([float(x) for x in plain[c]] if c in ("pixels", "origin", "axes") else plain[c] for c in columns)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.path)
        folder, names = f"{root}/{TEMPORARY}/{uuid.uuid4().hex}", []
        for row in iterator:
            r = row.asDict()
            content = codecs.writer_of(r["path"])(r)
            target = f"{folder}/{r['path']}"
            fs.create_dir(os.path.dirname(target), recursive=True)
            with fs.open_output_stream(target, compression=None) as f:
                f.write(gzip.compress(content, mtime=0) if r["path"].endswith(".gz") else content)
            names.append(r["path"])
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if os.path.basename(f.path) != TEMPORARY:
                    fs.delete_dir(f.path) if f.type == pafs.FileType.Directory else fs.delete_file(f.path)
        for m in filter(None, messages):
            for name in m.names:
                fs.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
                fs.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/{TEMPORARY}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{TEMPORARY}")


class ImageFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return codecs.SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageFolder)
