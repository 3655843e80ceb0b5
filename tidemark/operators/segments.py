"""Numbered samples to encoded segments and back, as columns of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import whole_div
from tidemark.sources import codecs, npy


def encode_segments(df: DataFrame, columns: list[str], codec: str, r: str = "r", rows: int = 32_768, chunk: int = 128) -> DataFrame:
    """segment, first_row, n_rows and data (a whole file of the codec, or `npy`) for each run of `rows` numbers."""

    def encode(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t.column(r).to_numpy(), kind="stable")
        first = int(t.column(r).to_numpy()[order[0]])
        x = np.stack([t.column(c).to_numpy() for c in columns], 1)[order]
        data = npy.to_bytes(x) if codec == "npy" else codecs.encode_file(x, codec, chunk)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "first_row": pa.array([first], pa.int64()), "n_rows": pa.array([len(x)], pa.int64()), "data": pa.array([data], pa.binary())})

    source = df.select(whole_div(F.col(r).cast("long"), rows).alias("segment"), r, *columns)
    return source.groupBy("segment").applyInArrow(encode, "segment long, first_row long, n_rows long, data binary")


def decode_segments(segments: DataFrame, columns: list[str], r: str = "r") -> DataFrame:
    """The numbered samples of encoded segments; the format is told by its first bytes."""

    def decode(batches):
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = npy.from_bytes(data) if data[:6] == b"\x93NUMPY" else codecs.decode_file(data)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(x))), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], [r, *columns])

    return segments.select("first_row", "data").mapInArrow(decode, f"{r} long, " + ", ".join(f"{c} short" for c in columns))
