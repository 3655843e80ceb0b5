"""A device's or a server's query interface over HTTP as a Spark data source, and its catalog.

`GET /query?resource&start&end&chunk_rows` answers with an array file of int16 [row, column], `GET /info?resource` with
JSON. A range is split into spans of whole seconds, a request and a task each.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, ShortType, StructField, StructType

from tidemark.sources.npy import from_bytes

TIMEOUT = 60


def get(url: str, path: str, **asked) -> bytes:
    """The body of an answer; other answers than 200 and addresses that aren't HTTP raise."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError("an http address is asked for")
    with urllib.request.urlopen(f"{url.rstrip('/')}/{path}?{urllib.parse.urlencode(asked)}", timeout=TIMEOUT) as answer:
        return answer.read()


def info(url: str, resource: str) -> dict:
    """What the server's catalog says of a resource."""
    return json.loads(get(url, "info", resource=resource))


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RemoteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.url, self.resource, self.schema = options["url"], options["resource"], schema
        self.start, self.end = int(options["start"]), int(options["end"])
        self.each, self.chunk = int(options.get("seconds", "3600")), int(options.get("chunk_rows", "600"))
        if self.end <= self.start or self.each <= 0:
            raise ValueError("the end must lie behind the start, and a span has a second or more")

    def partitions(self):
        return [_Span(a, min(self.end, a + self.each)) for a in range(self.start, self.end, self.each)]

    def read(self, partition):
        data = from_bytes(get(self.url, "query", resource=self.resource, start=partition.start, end=partition.end, chunk_rows=self.chunk))
        names = self.schema.fieldNames()
        if len(data) and data.shape[1] != len(names) - 2:
            raise ValueError(f"{data.shape[1]} columns came, {len(names) - 2} are named")
        for a in range(0, len(data), 8192):
            part = data[a : a + 8192]
            place = np.arange(a, a + len(part))
            columns = [pa.array(np.ascontiguousarray(part[:, c])) for c in range(part.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), partition.start)), pa.array(place), *columns], names)


class RemoteSource(DataSource):
    """Format `remote`: options url, resource, columns (comma-joined), start, end, seconds (of a task) and chunk_rows.

    Rows are (start_s, i, columns): the i-th row of the span from start_s. Answers hold no times; where a span has no
    gaps, a row's time is start_s + i hops. A span without data has no rows.
    """

    @classmethod
    def name(cls):
        return "remote"

    def schema(self):
        columns = self.options["columns"].split(",")
        return StructType([StructField("start_s", LongType()), StructField("i", LongType()), *(StructField(c, ShortType()) for c in columns)])

    def reader(self, schema):
        return RemoteReader(self.options, schema)
