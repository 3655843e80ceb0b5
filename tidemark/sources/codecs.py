"""Chunk files of int16 samples in three codecs, as a Spark data source and as plain functions.

Formats, little-endian. File header, 8 bytes: magic (4), version (u8), columns (u8), rows of a chunk (u16).
DES9 chunk, column by column: seed (i16), words (u16), rows (u16), then the words (u32). The differences to the row
before, the first to the seed, are zigzag coded in 17 bits and packed: the top 4 bits of a word select how many codes
of how many bits it holds. RW16 chunk: rows (u16), then the samples row by row. RC16: rows (u16), then column by column.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, ShortType, StringType, StructField, StructType

#: Fixed values of the file format: magic by codec, and (bits, codes) of a word by selector.
MAGIC = {"compressed": b"DES9", "raw": b"RW16", "raw_col": b"RC16"}
SELECTORS = ((1, 28), (2, 14), (3, 9), (4, 7), (5, 5), (7, 4), (9, 3), (14, 2), (28, 1))
HEADER = struct.Struct("<4sBBH")
VERSION = 1


def pack_words(codes: np.ndarray) -> np.ndarray:
    """Unsigned codes of at most 28 bits as words: each takes the most codes that fit, fewer only at the end."""
    codes = np.asarray(codes, np.uint32).tolist()
    bits = [c.bit_length() for c in codes]
    words, at, n = [], 0, len(codes)
    while at < n:
        for selector, (b, count) in enumerate(SELECTORS):
            take = min(count, n - at)
            if bits[at] <= b and max(bits[at : at + take]) <= b:
                word, shift = selector << 28, 0
                for c in codes[at : at + take]:
                    word |= c << shift
                    shift += b
                words.append(word)
                at += take
                break
        else:
            raise ValueError("a code has more than 28 bits")
    return np.array(words, np.uint32)


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n codes of packed words."""
    words = np.asarray(words, np.uint32)
    selector = words >> 28
    if len(words) and int(selector.max()) >= len(SELECTORS):
        raise ValueError("unknown selector")
    counts = np.array([c for _, c in SELECTORS])[selector]
    bits = np.array([b for b, _ in SELECTORS], np.uint32)[selector]
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    each = np.repeat(bits, counts)
    out = (np.repeat(words & np.uint32(0x0FFFFFFF), counts) >> (at.astype(np.uint32) * each)) & ((np.uint32(1) << each) - np.uint32(1))
    if len(out) < n:
        raise ValueError("too few words")
    return out[:n]


def zigzag(values: np.ndarray, seed: int) -> np.ndarray:
    d = np.diff(np.asarray(values, np.int64), prepend=seed)
    return (((d << 1) ^ (d >> 16)) & 0x1FFFF).astype(np.uint32)


def unzigzag(codes: np.ndarray, seed: int) -> np.ndarray:
    c = np.asarray(codes, np.int64)
    return (seed + np.cumsum((c >> 1) ^ -(c & 1))).astype(np.int16)


def encode_chunk(rows: np.ndarray, codec: str) -> bytes:
    """One chunk from [row, column] samples."""
    rows = np.ascontiguousarray(rows, "<i2")
    if codec == "raw":
        return struct.pack("<H", len(rows)) + rows.tobytes()
    if codec == "raw_col":
        return struct.pack("<H", len(rows)) + rows.T.tobytes()
    out = []
    for col in rows.T:
        words = pack_words(zigzag(col, int(col[0]))).astype("<u4")
        out.append(struct.pack("<hHH", int(col[0]), len(words), len(rows)) + words.tobytes())
    return b"".join(out)


def encode_file(rows: np.ndarray, codec: str = "compressed", chunk: int = 128) -> bytes:
    rows = np.asarray(rows)
    if codec not in MAGIC:
        raise ValueError(f"codec must be one of {sorted(MAGIC)}")
    if rows.ndim != 2 or not 0 < rows.shape[1] < 256 or not 0 < chunk < 65536:
        raise ValueError("samples must be [row, column] with at most 255 columns, and chunks at most 65535 rows")
    if len(rows) and (rows.min() < -32768 or rows.max() > 32767):
        raise ValueError("samples must be int16")
    head = HEADER.pack(MAGIC[codec], VERSION, rows.shape[1], chunk)
    return head + b"".join(encode_chunk(rows[i : i + chunk], codec) for i in range(0, len(rows), chunk))


def read_header(data: bytes) -> tuple[str, int, int]:
    """codec, columns, rows of a chunk; raises ValueError for other files."""
    if len(data) < HEADER.size:
        raise ValueError("no sample file")
    magic, version, columns, chunk = HEADER.unpack_from(data)
    codec = {m: c for c, m in MAGIC.items()}.get(magic)
    if codec is None or version != VERSION:
        raise ValueError("no sample file of a known codec and version")
    return codec, columns, chunk


def decode_chunks(data: bytes, columns: list[int] | None = None) -> Iterator[np.ndarray]:
    """Chunks [row, wanted column] of a file; packed and column-wise chunks unpack the wanted columns only."""
    codec, n_cols, _ = read_header(data)
    want = list(range(n_cols)) if columns is None else columns
    at = HEADER.size
    while at < len(data):
        if codec == "compressed":
            got: dict[int, np.ndarray] = {}
            for c in range(n_cols):
                seed, n_words, n = struct.unpack_from("<hHH", data, at)
                at += 6
                if c in want:
                    got[c] = unzigzag(unpack_words(np.frombuffer(data, "<u4", n_words, at), n), seed)
                at += 4 * n_words
            yield np.stack([got[c] for c in want], 1) if want else np.zeros((n, 0), np.int16)
            continue
        n = struct.unpack_from("<H", data, at)[0]
        block = np.frombuffer(data, "<i2", n * n_cols, at + 2)
        at += 2 + 2 * n * n_cols
        yield block.reshape(n, n_cols)[:, want] if codec == "raw" else block.reshape(n_cols, n)[want].T


def decode_file(data: bytes) -> np.ndarray:
    parts = list(decode_chunks(data))
    return np.concatenate(parts) if parts else np.zeros((0, read_header(data)[1]), np.int16)


def append_file(data: bytes, rows: np.ndarray) -> bytes:
    """A file's bytes with more rows as further chunks; raises ValueError if the columns differ."""
    codec, n_cols, chunk = read_header(data)
    if np.asarray(rows).shape[1:] != (n_cols,):
        raise ValueError("the file has other columns")
    return data + encode_file(rows, codec, chunk)[HEADER.size :]


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _files(path: str, suffix: str) -> list[str]:
    """A file, or all of a folder with the suffix, in name order; s3, hdfs and other stores by pyarrow."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, p = FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (None, _local(path))
    if fs is None:
        return [p] if os.path.isfile(p) else sorted(f"{p}/{x}" for x in os.listdir(p) if x.endswith(suffix))
    if fs.get_file_info(p).type == FileType.File:
        return [path]
    scheme = path.split("://")[0]
    return sorted(f"{scheme}://{x.path}" for x in fs.get_file_info(FileSelector(p)) if x.path.endswith(suffix))


def _bytes(path: str):
    """A file's bytes; a local one is mapped, so that columns which nobody decodes aren't read."""
    from pyarrow.fs import FileSystem

    if "://" in path and not path.startswith("file:"):
        fs, p = FileSystem.from_uri(path)
        with fs.open_input_stream(p) as f:
            return f.read()
    own = _local(path)
    return np.memmap(own, np.uint8, "r").data if os.path.getsize(own) else b""


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChunkReader(DataSourceReader):
    """A task per file: chunks have no index, so a file is read from its start."""

    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.names, self.wanted = options.get("columns"), options.get("select")

    def partitions(self):
        return [_File(p) for p in _files(self.path, ".des9")]

    def read(self, partition):
        names, data = self.schema.fieldNames(), _bytes(partition.path)
        columns = _names(self.names, read_header(data)[1])
        want = [columns.index(c) for c in (self.wanted.split(",") if self.wanted else columns)]
        at = 0
        for rows in decode_chunks(data, want):
            cols = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(np.arange(at, at + len(rows))), *cols], names)
            at += len(rows)


class _Wrote(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class ChunkWriter(DataSourceArrowWriter):
    """Each task streams its chunks to a file of its own; the driver gives all their final names when all have ended.

    A write's names begin with its time and hold a number of its own, so appended files stand behind the earlier ones
    and never replace them. Overwriting removes the earlier files after the new ones have their names: a crash in
    between leaves both, never neither. A store's files are written by pyarrow's file systems.
    """

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.uri = options["path"]
        self.codec, self.chunk, self.overwrite = options.get("codec", "compressed"), int(options.get("chunk", "128")), overwrite
        encode_file(np.zeros((0, len(schema.fields)), int), self.codec, self.chunk)  # refuses what can't be written
        self.n = len(schema.fields)
        self.number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _fs(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.uri.rstrip("/")) if "://" in self.uri and not self.uri.startswith("file:") else (LocalFileSystem(), _local(self.uri).rstrip("/"))

    def write(self, batches):
        from pyspark import TaskContext

        (fs, folder), context = self._fs(), TaskContext.get()
        name, out, held = f"{folder}/.{self.number}-{context.partitionId():06d}.{context.taskAttemptId()}.tmp", None, np.zeros((0, self.n), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(name)
                out.write(encode_file(held, self.codec, self.chunk))
            held = np.concatenate([held, np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in b.columns], 1)])
            whole = len(held) // self.chunk * self.chunk
            out.write(encode_file(held[:whole], self.codec, self.chunk)[HEADER.size :])
            held = held[whole:]
        if out is None:
            return _Wrote(None)
        out.write(encode_file(held, self.codec, self.chunk)[HEADER.size :])
        out.close()
        return _Wrote(f"{name}|part-{self.number}-{context.partitionId():06d}.des9")

    def commit(self, messages):
        from pyarrow.fs import FileSelector

        fs, folder = self._fs()
        before = [x.path for x in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if x.path.endswith(".des9")] if self.overwrite else []
        for m in messages:
            if m and m.path:
                own, final = m.path.split("|")
                fs.move(own, f"{folder}/{final}")
        for x in before:
            fs.delete_file(x)

    def abort(self, messages):
        fs, _ = self._fs()
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path.split("|")[0])


def _names(given: str | None, n: int) -> list[str]:
    names = given.split(",") if given else [f"c{i}" for i in range(n)]
    if len(names) != n:
        raise ValueError(f"the file has {n} columns")
    return names


class ChunkSource(DataSource):
    """Format `samples`: options path, columns (all names, comma-joined), select (those to read), codec and chunk (for writing)."""

    @classmethod
    def name(cls):
        return "samples"

    def schema(self):
        names = self.options.get("select") or self.options.get("columns")
        names = names.split(",") if names else _names(None, read_header(_bytes(_files(self.options["path"], ".des9")[0]))[1])
        return StructType([StructField("file", StringType()), StructField("pos", LongType()), *(StructField(c, ShortType()) for c in names)])

    def reader(self, schema):
        return ChunkReader(self.options, schema)

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options, schema, overwrite)
