"""Folders of gridded binary files (see wps) as a data source of Spark's, with filters taken into the reader.

    gridded.register(spark)
    spark.read.format("windgrid_gridded").load(folder).where("field = 'TT' AND level = 100")

A row is a cell: path, date, field, level, i, j, value, error. Partitions are planned by the sizes
of the files: a task takes files in order until they come to `bytes_a_task` (an option, 64 MB by default; opening
a file counts as 1 MB), so many small files make few tasks and a large one stands alone.
Equality and IN on date, field, level, i and j go into the reader: of a field that isn't wanted the
header alone is read, of a wanted one the cells that are asked for, in one range if i and j are fixed.
Whether a row has an error (IS NULL, IS NOT NULL) goes there, too. Options lat and lon together give the nearest cell of each field.

A file that can't be opened or parsed is a row with an error, after the fields before its
fault; its other columns are null, so a filter on a field leaves it out: count errors by themselves, with
error IS NOT NULL. With option rows = "files" a row is a file: path, bytes, bytes_read, fields, error.
Files are listed and opened by pyarrow's file systems; wps.read(by_ranges=False) reads from other stores.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from ..deploy import ship
from . import wps
from .folder import opened

FORMAT = "windgrid_gridded"
BYTES_A_TASK, OPENING = 64 << 20, 1 << 20
BY_FILE = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("bytes_read", pa.int64()), ("fields", pa.int32()), ("error", pa.string())])
BY_FILE_KINDS = "path string, bytes long, bytes_read long, fields int, error string"
PUSHED = ("date", "field", "level", "i", "j")


@dataclass
class Share(InputPartition):
    """The files of one task, with their sizes."""

    files: list[tuple[str, int]]


def planned(files: list[tuple[str, int]], bytes_a_task: int) -> list[Share]:
    """Files in order, cut where a task has enough."""
    out, held = [], 0
    for path, size in files:
        cost = size + OPENING
        if not out or held + cost > bytes_a_task:
            out.append(Share([]))
            held = 0
        out[-1].files.append((path, size))
        held += cost
    return out


class _Wanted:
    """What the filters leave: sets of values by column; whether rows with an error, or without, are asked for."""

    def __init__(self) -> None:
        self.values: dict[str, set] = {}
        self.errors, self.cells = True, True

    def take(self, f: Filter) -> bool:
        """Whether the filter is taken in whole."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == "error" and isinstance(f, (IsNull, IsNotNull)):
            self.errors &= isinstance(f, IsNotNull)
            self.cells &= isinstance(f, IsNull)
            return True
        if column not in PUSHED:
            return False
        if isinstance(f, IsNotNull):  # an error's row has nothing here
            self.errors = False
            return True
        if isinstance(f, EqualTo) or isinstance(f, EqualNullSafe) and f.value is not None:
            values = {f.value}
        elif isinstance(f, In):
            values = {v for v in f.value if v is not None}
        else:
            return False
        self.values[column] = self.values.get(column, values) & values
        self.errors = False
        return True

    def has(self, column: str, value) -> bool:
        return column not in self.values or value in self.values[column]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.wanted = options, _Wanted()
        point = options.get("lat"), options.get("lon")
        self.point = tuple(map(float, point)) if None not in point else None
        self.by_file = options.get("rows") == "files"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.by_file or not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, inside = opened(self.options["path"])
        info = store.get_file_info(inside)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
        found = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return planned(found, int(self.options.get("bytes_a_task", BYTES_A_TASK)))

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.options["path"])
        for path, size in share.files if share else ():  # Spark plans one task of nothing where there are no files
            if self.by_file:
                yield self._report(store, path, size)
            else:
                yield from self._cells(store, path)

    def _cells(self, store, path: str) -> Iterator[pa.RecordBatch]:
        def error(text: str) -> Iterator[pa.RecordBatch]:
            if self.wanted.errors:
                yield pa.RecordBatch.from_pylist([{"path": path, "error": text}], schema=wps.ROW)

        try:
            with store.open_input_file(path) as f:
                file = wps.Ranges(f, f.size())
                for field in wps.fields(file, self.wanted.values.get("field")):
                    if self.wanted.cells and all(self.wanted.has(c, field[c]) for c in ("date", "level")):
                        i, j, value = self._part(file, field)
                        if n := len(i):
                            same = [pa.array([field[c]] * n, t) for c, t in (("date", pa.string()), ("field", pa.string()), ("level", pa.float64()))]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * n), *same, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value), pa.nulls(n, pa.string())], schema=wps.ROW)
        except (ValueError, struct.error, UnicodeDecodeError) as e:
            yield from error(str(e))
        except (OSError, pa.ArrowException) as e:
            yield from error(f"can't open: {e}")

    def _part(self, file: wps.Ranges, field: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns, rows = (self.wanted.values.get(c) for c in ("i", "j"))
        if self.point:
            i, j, value = wps.cells(file, field, self.point)
        elif columns is not None and rows is not None and len(columns) * len(rows) <= 16:
            at = [(i, j) for j in sorted(rows) for i in sorted(columns) if 0 <= i < field["nx"] and 0 <= j < field["ny"]]
            parts = [file.at(field["data"] + 4 * (j * field["nx"] + i), 4) for i, j in at]
            return *(np.array([p[k] for p in at], dtype=np.int32) for k in (0, 1)), np.frombuffer(b"".join(parts), ">f4").astype(float)
        else:
            i, j, value = wps.cells(file, field)
        keep = np.ones(len(i), dtype=bool)
        for at, some in ((i, columns), (j, rows)):
            if some is not None:
                keep &= np.isin(at, list(some))
        return i[keep], j[keep], value[keep]

    def _report(self, store, path: str, size: int) -> pa.RecordBatch:
        n, failed, file = 0, None, None
        names = set(self.options["fields"].split(",")) if self.options.get("fields") else None
        try:
            with store.open_input_file(path) as f:
                file = wps.Ranges(f, f.size())
                for field in wps.fields(file, names):
                    wps.cells(file, field, self.point)
                    n += 1
        except (ValueError, struct.error, UnicodeDecodeError, OSError, pa.ArrowException) as e:
            failed = str(e)
        row = {"path": path, "bytes": size, "bytes_read": file.read_bytes if file else 0, "fields": n, "error": failed}
        return pa.RecordBatch.from_pylist([row], schema=BY_FILE)


class Gridded(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BY_FILE_KINDS if self.options.get("rows") == "files" else wps.KINDS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets the session hand filters to Python sources (they have to be switched on for it)."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Gridded)


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A folder's cells; filters that follow go into the reader. options: see the module."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(folder)
