"""NumPy array files of int16 [row, column] as a Spark data source; reading maps the file and splits it by rows."""

from __future__ import annotations

import io
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, ShortType, StructField, StructType


def header(n_rows: int, n_cols: int) -> bytes:
    """Version 1.0 header of a little-endian int16 array in C order, padded to a multiple of 64 bytes."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<i2", "fortran_order": False, "shape": (n_rows, n_cols)})
    return out.getvalue()


def to_bytes(rows: np.ndarray) -> bytes:
    rows = np.ascontiguousarray(rows, "<i2")
    return header(*rows.shape) + rows.tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    out = np.load(io.BytesIO(data), allow_pickle=False)
    if out.ndim != 2 or out.dtype != np.dtype("<i2"):
        raise ValueError("an int16 array of rows and columns is asked for")
    return out


def response(df: DataFrame, columns: list[str], batch: int = 4096):
    """Bytes of a query's rows as one array file, in parts: the header has the rows that there are, rows follow as they come."""
    yield header(df.count(), len(columns))
    held = []
    for r in df.select(*columns).toLocalIterator(prefetchPartitions=True):
        held.append(tuple(r))
        if len(held) == batch:
            yield np.array(held, "<i2").tobytes()
            held = []
    if held:
        yield np.array(held, "<i2").tobytes()


def save(df: DataFrame, columns: list[str], order: str, path: str) -> None:
    """Write rows in order to one local file; whole or not at all."""
    with open(f"{path}.tmp", "wb") as f:
        for part in response(df.orderBy(order), columns):
            f.write(part)
    os.replace(f"{path}.tmp", path)


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class NpyReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema, self.each = options["path"].removeprefix("file://"), schema, int(options.get("rows", "1000000"))

    def partitions(self):
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Rows(i, min(n, i + self.each)) for i in range(0, max(1, n), self.each)]

    def read(self, partition):
        data = np.load(self.path, mmap_mode="r")
        for a in range(partition.first, partition.last, 8192):
            part = np.ascontiguousarray(data[a : min(partition.last, a + 8192)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(part.shape[1]))], self.schema.fieldNames())


class NpySource(DataSource):
    """Format `npy`: options path, columns (names, comma-joined) and rows (of a task)."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        data = np.load(self.options["path"].removeprefix("file://"), mmap_mode="r")
        if data.ndim != 2 or data.dtype != np.dtype("<i2"):
            raise ValueError("an int16 array of rows and columns is asked for")
        names = self.options.get("columns")
        names = names.split(",") if names else [f"c{i}" for i in range(data.shape[1])]
        if len(names) != data.shape[1]:
            raise ValueError("the array has another number of columns")
        return StructType([StructField("i", LongType()), *(StructField(c, ShortType()) for c in names)])

    def reader(self, schema):
        return NpyReader(self.options, schema)


def register(spark) -> None:
    from tidemark.sources.codecs import ChunkSource
    from tidemark.sources.remote import RemoteSource

    for source in (NpySource, ChunkSource, RemoteSource):
        spark.dataSource.register(source)
