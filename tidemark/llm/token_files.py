"""Operator 10: token ids in bit-packed binary files.

File format, all numbers little-endian: the magic b"TIDEPK01", then eight uint64: bits per id, vocabulary size,
documents D, ids T, ids per block, blocks B, file number, 0. Then int64[D] document ids, uint64[D + 1] first id of
each document, uint64[B + 1] byte offset of each block in the payload, and the payload. A block packs its ids one
after another, lowest bit first, in the fewest bits that hold the largest id of the vocabulary, and ends on a whole
byte. Any document can be read by its first and last block alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import chunks, claim, cut, shared_dir
from tidemark.llm.units import Units

MAGIC = b"TIDEPK01"
BLOCK = 4096
#: Ids after which a file is closed and the next begun.
FILE_IDS = 16 << 20
#: Stored bytes of a range of ids; most ranges, for plans whose size isn't known.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 21
MANIFEST = "path string, part int, seq int, n_docs long, n_ids long"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):  # the same layout as below
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocab_size: int, number: int = 0) -> bytes:
    bits = bits_for(vocab_size)
    if len(ids) and int(ids.max()) >= vocab_size:
        raise ValueError("an id lies outside the vocabulary")
    packed = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    head = np.array([bits, vocab_size, len(doc_ids), len(ids), BLOCK, len(packed), number, 0], "<u8")
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    at = np.concatenate(([0], np.cumsum([len(x) for x in packed]))).astype("<u8")
    return b"".join([MAGIC, head.tobytes(), np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), at.tobytes(), *packed])


class TokenFile:
    """Random access to the documents of one file, held as bytes or as a memory map."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a packed token file")
        self.bits, self.vocab_size, d, self.n_ids, self.block, b, self.number, _ = (int(x) for x in np.frombuffer(data, "<u8", 8, 8))
        self.doc_ids = np.frombuffer(data, "<i8", d, 72)
        self.starts = np.frombuffer(data, "<u8", d + 1, 72 + 8 * d).astype(np.int64)
        self.at = np.frombuffer(data, "<u8", b + 1, 80 + 16 * d).astype(np.int64)
        self.data, self.base = data, 80 + 16 * d + 8 * (b + 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1, from the blocks that hold them."""
        if first >= last:
            return np.zeros(0, np.uint32)
        b0, b1 = first // self.block, (last - 1) // self.block
        got = [unpack(self.data[self.base + self.at[b] : self.base + self.at[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(b0, b1 + 1)]
        return np.concatenate(got)[first - b0 * self.block : last - b0 * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def put(path: str, data: bytes) -> None:
    """Write a whole file or none: a retried or twin task leaves the same bytes under the same name."""
    if path.startswith("file:") or "://" not in path:
        path = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, path)
        return
    from pyarrow.fs import FileSystem

    fs, p = FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    own = f"{p}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, p)


def get(path: str) -> bytes:
    if path.startswith("file:") or "://" not in path:
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
            return f.read()
    from pyarrow.fs import FileSystem

    fs, p = FileSystem.from_uri(path)
    with fs.open_input_stream(p) as f:
        return f.read()


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct unit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.line = self.whole("\n")
        self.encode = Units(self.learn, self.whole, specials)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units with white space only in front go to the library as lines of one text, split again at the line ends."""
        out: list = [None] * len(units)
        lines, places = [], []
        for i, u in enumerate(units):
            if u[0] in " \n" and (u[1:].isalnum() or len(u.split()) == 1 and not u[1].isspace() and not u[-1].isspace()):
                lines.append(u[1:] if u[0] == "\n" else u)
                places.append(i)
            else:
                out[i] = self.whole(u)
        line = self.line
        for at in range(0, len(lines), 20_000):
            part = lines[at : at + 20_000]
            ids = self.whole("\n".join(part))
            ends = np.append(np.flatnonzero(ids == line[0]), len(ids)).tolist()
            if len(ends) != len(part):
                raise AssertionError("lines and units differ")
            a = 0
            for i, z in zip(places[at : at + 20_000], ends, strict=True):
                out[i] = np.concatenate((line, ids[a:z])) if units[i][0] == "\n" else ids[a:z]
                a = z + 1
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(col)


@lru_cache(2)
def _worker(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(df: DataFrame, tokenizer: str, out_dir: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the manifest, one row per file.

    File order is (part, seq), and rows within a file ascend by id; repeated ids are ordered by their text.
    Null ids come first and are stored as the smallest int64. A null text has the end id alone. An empty table
    gives an empty manifest. Ranges of ids are equal in rows and come from Spark's range partitioner, so the
    only shuffle is the one that the order asks for; equal and null ids are parted by their text. There are as many
    ranges as the table's bytes ask for, RANGE_BYTES each. Each task holds at most FILE_IDS ids and one batch.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of files as they are stored
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = partitions or max(least, min(-(-size // RANGE_BYTES), MOST_RANGES))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_files", _worker.cache_clear)
        encode, part, seq = _worker(tokenizer), TaskContext.get().partitionId(), 0
        docs, sizes, held, n_ids = [], [], [], 0

        def close():
            nonlocal docs, sizes, held, n_ids, seq
            path = f"{out_dir}/tokens-{part:06d}-{seq:05d}.bin"
            lengths = np.concatenate(sizes)
            put(path, to_bytes(np.concatenate(docs), lengths, np.concatenate(held), encode.vocab_size, seq))
            row = pa.RecordBatch.from_pylist([{"path": path, "part": part, "seq": seq, "n_docs": len(lengths), "n_ids": n_ids}], pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            docs, sizes, held, n_ids, seq = [], [], [], 0, seq + 1
            return row

        for whole in batches:
            for b in chunks(whole, "text"):
                ids, lengths = encode(b.column(1))
                with_end = np.full(len(ids) + len(lengths), end_id, np.uint32)
                ends = np.cumsum(lengths + 1) - 1
                body = np.ones(len(with_end), bool)
                body[ends] = False
                with_end[body] = ids
                docs.append(b.column(0).to_numpy())
                sizes.append(lengths + 1)
                held.append(with_end)
                n_ids += len(with_end)
                if n_ids >= FILE_IDS:
                    yield close()
        if sizes:
            yield close()

    return cut(rows.mapInArrow(run, MANIFEST), "manifest")[0]


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files.

    Only the manifest, a row per file of FILE_IDS ids, is ordered in one place for the files' first ids. Ids that were
    null are the smallest int64. A document without text has one id, the end. An empty manifest gives no rows.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spark: SparkSession = manifest.sparkSession
    files = files.select("path", "base").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(get(path))
                at, out = 0, []
                while at < len(f.doc_ids):  # runs of documents of about a million ids
                    to = max(at + 1, int(np.searchsorted(f.starts, f.starts[at] + (1 << 20), side="right")) - 1)
                    ids = f.ids(int(f.starts[at]), int(f.starts[to])).astype("<u4").tobytes()
                    cuts = (f.starts[at : to + 1] - f.starts[at]) * 4
                    out += [zlib.crc32(ids[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                    at = to
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids), pa.array(f.starts[:-1] + base), pa.array(np.diff(f.starts)), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, tokenizer: str) -> DataFrame:
    return read(write(df, tokenizer, shared_dir(df.sparkSession, "token_files")))
