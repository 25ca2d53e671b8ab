"""A sink for whole files: rows of path and content become files of a folder, as a data source of Spark's.

    folder.register(spark)
    files.write.format("windgrid_files").mode("append").save(to)

Tasks write. A file gets its name when it is whole, by a move from a name of its
attempt's own, so a failed task leaves no half file behind and one that is repeated replaces
the same file with the same content. Paths may hold folders (run/name). A path that stands in two rows
has the content of one of them. Null contents are empty files; a null path is an error.
The folder's file system is one that workers can open (pyarrow's).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..deploy import ship

FORMAT = "windgrid_files"


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes it
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def put(store, folder: str, path: str, content: bytes) -> None:
    """One whole file."""
    to = f"{folder}/{path}"
    above, _, name = to.rpartition("/")
    store.create_dir(above)
    attempt = f"{above}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as f:
        f.write(content)
    store.move(attempt, to)


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        store, inside = opened(self.folder)
        n = 0
        for row in rows:
            if row["path"] is None:
                raise ValueError("a file without a path")
            put(store, inside, row["path"], bytes(row["content"] or b""))
            n += 1
        return Written(n)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are added or replaced one by one: use mode append")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Files)


def write(files: DataFrame, folder: str) -> None:
    """files (path, content) as files of a folder."""
    register(files.sparkSession)
    files.select("path", "content").write.format(FORMAT).mode("append").save(folder)
