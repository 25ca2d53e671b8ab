"""netCDF classic files (versions 1 and 2): the header lists dimensions, attributes and variables with their places.

The format is public and needs no library. Files of version 4 are HDF5 containers and are reported as errors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..deploy import ship

# Fixed values of the format: tags of the header's lists, and types by number.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    dtype: np.dtype
    begin: int
    by_record: bool
    attributes: dict = field(default_factory=dict)


class Header:
    """What a file holds. Reads the header alone; values() reads a variable."""

    def __init__(self, data: bytes) -> None:
        self.data, self.place = memoryview(data), 4
        if bytes(self.data[:3]) != b"CDF" or self.data[3] not in (1, 2):
            raise ValueError("not a netCDF classic file")
        wide = self.data[3] == 2
        self.records = self._int()
        sizes = [(self._name(), self._int()) for _ in range(self._count(DIMENSION))]
        self.dims = dict(sizes)
        self.attributes = self._attributes()
        self.variables: dict[str, Variable] = {}
        for _ in range(self._count(VARIABLE)):
            name = self._name()
            own = [sizes[self._int()] for _ in range(self._int())]
            attributes = self._attributes()
            kind, _, begin = self._int(), self._int(), self._long() if wide else self._int()
            by_record = bool(own) and own[0][1] == 0
            shape = [self.records if n == 0 else n for _, n in own]
            self.variables[name] = Variable(name, [d for d, _ in own], shape, np.dtype(TYPES[kind]), begin, by_record, attributes)
        each = [self._slab(v) for v in self.variables.values() if v.by_record]
        self.record_bytes = each[0][0] if len(each) == 1 else sum(padded for _, padded in each)  # a lone one isn't padded

    def _take(self, n: int) -> memoryview:
        if self.place + n > len(self.data):
            raise ValueError("header cut short")
        self.place += n
        return self.data[self.place - n : self.place]

    def _int(self) -> int:
        return struct.unpack(">i", self._take(4))[0]

    def _long(self) -> int:
        return struct.unpack(">q", self._take(8))[0]

    def _padded(self, n: int) -> bytes:
        return bytes(self._take(n + -n % 4)[:n])

    def _name(self) -> str:
        return self._padded(self._int()).decode()

    def _count(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if n and found != tag:
            raise ValueError(f"list {found} for {tag}")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._count(ATTRIBUTE)):
            name, kind, n = self._name(), self._int(), self._int()
            raw = self._padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    def _slab(self, v: Variable) -> tuple[int, int]:
        n = int(np.prod(v.shape[1:], dtype=np.int64)) * v.dtype.itemsize
        return n, n + -n % 4

    def values(self, name: str) -> np.ndarray:
        v = self.variables[name]
        if not v.by_record:
            n = int(np.prod(v.shape, dtype=np.int64))
            return np.frombuffer(self.data, v.dtype, n, v.begin).reshape(v.shape)
        n, _ = self._slab(v)
        places = [v.begin + k * self.record_bytes for k in range(self.records)]
        parts = [np.frombuffer(self.data[p : p + n], v.dtype).reshape(v.shape[1:]) for p in places]
        return np.stack(parts) if parts else np.zeros(v.shape, v.dtype)


def encode(variables: dict[str, tuple[list[str], np.ndarray]], attributes: dict[str, str | float] | None = None) -> bytes:
    """A version-1 file of fixed dimensions: name -> (dimensions, values)."""
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    number = {">i4": 4, ">f4": 5, ">f8": 6}
    dims: dict[str, int] = {}
    for names, values in variables.values():
        dims |= dict(zip(names, values.shape, strict=True))
    arrays = {k: v.astype(np.dtype(v.dtype).newbyteorder(">")) for k, (_, v) in variables.items()}
    head = b"CDF\x01" + struct.pack(">iii", 0, DIMENSION if dims else 0, len(dims)) + b"".join(text(d) + struct.pack(">i", n) for d, n in dims.items())
    own = b""
    for name, v in (attributes or {}).items():
        own += text(name) + (struct.pack(">i", 2) + text(v) if isinstance(v, str) else struct.pack(">iid", 6, 1, v))
    head += struct.pack(">ii", ATTRIBUTE if attributes else 0, len(attributes or {})) + own + struct.pack(">ii", VARIABLE, len(variables))
    entry = lambda k: text(k) + struct.pack(">i", len(variables[k][0])) + b"".join(struct.pack(">i", list(dims).index(d)) for d in variables[k][0]) + struct.pack(">ii", 0, 0)
    place = len(head) + sum(len(entry(k)) + 12 for k in variables)
    body = b""
    for k, a in arrays.items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 4)
        head += entry(k) + struct.pack(">iii", number[a.dtype.str], len(raw), place + len(body))
        body += raw
    return head + body


ROWS = pa.schema([("path", pa.string()), ("variable", pa.string()), ("record", pa.int32()), ("j", pa.int32()), ("i", pa.int32()), ("value", pa.float64()), ("error", pa.string())])


def _text(v) -> str:
    return v if isinstance(v, str) else ",".join(map(str, v))


def parse(files: DataFrame, variables: list[str], said: tuple[str, ...] = ()) -> DataFrame:
    """files (path, content) to a row a cell of the wanted variables: path, variable, record (0 without a record or leading dimension), j, i, value; or the file's error.

    said: attributes of the file that stand beside each cell as text, in columns of their names (null where a file has none).
    """
    ship(files.sparkSession)
    rows = pa.schema([*ROWS, *[(a, pa.string()) for a in said]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for path, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                try:
                    head = Header(content.as_buffer())
                    beside = [_text(head.attributes[a]) if a in head.attributes else None for a in said]
                    for name in variables:
                        values = head.values(name)
                        values = values.reshape((-1, *values.shape[-2:]) if values.ndim > 1 else (1, 1, -1))
                        record, j, i = (a.ravel().astype(np.int32) for a in np.indices(values.shape))
                        n = len(i)
                        columns = [pa.array([path] * n), pa.array([name] * n), pa.array(record), pa.array(j), pa.array(i), pa.array(values.ravel().astype(float)), pa.nulls(n, pa.string())]
                        columns += [pa.array([b] * n, pa.string()) for b in beside]
                        yield pa.RecordBatch.from_arrays(columns, schema=rows)
                except (ValueError, KeyError, struct.error, UnicodeDecodeError) as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": f"{type(e).__name__}: {e}"}], schema=rows)

    return files.select("path", "content").mapInArrow(run, "path string, variable string, record int, j int, i int, value double, error string" + "".join(f", `{a}` string" for a in said))


def attributes(files: DataFrame) -> DataFrame:
    """path, name, value (as text) of the files' own attributes."""
    ship(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for path, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                found = Header(content.as_buffer()).attributes
                rows = [{"path": path, "name": k, "value": _text(v)} for k, v in found.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, name string, value string")
