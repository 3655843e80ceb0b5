"""What the corpus operators share: tables, shared folders, Arrow batches and sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; temporaries are about 60 times this.
CHUNK_BYTES = 2 << 20
#: A key with more than one part in HOT of all rows is hot; there are fewer than HOT of them.
HOT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name that driver and executors all see; the folder goes when the application ends.

    The cluster names the parent in spark.checkpoint.dir. Only where that is unset on one machine (tests) a folder under
    the temporary directory stands in for it; elsewhere it is an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    return df.mapInArrow(fn, schema)


_claimed: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say that this worker now remembers things for one operator; what it remembered for others is forgotten."""
    for other in [x for x in _claimed if x != name]:
        _claimed.pop(other)()
        tidy()
    _claimed[name] = clear


def tidy() -> None:
    """Give freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `most` bytes of text each; a longer single text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(offsets_and_bytes(batch.column(batch.schema.get_field_index(column)))[0])
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    tidy()


def offsets_and_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the UTF-8 bytes of a string column; a null has no bytes."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    bufs = col.buffers()
    if not n or bufs[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if col.null_count:
        valid = np.asarray(col.is_valid())
        sizes = np.diff(off)
        if sizes[~valid].any():  # bytes under a null slot don't count
            data = data[np.repeat(valid, sizes)]
            off = np.concatenate(([0], np.cumsum(np.where(valid, sizes, 0))))
    return off, data


def texts(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def text_keys(col="text") -> list:
    """Two independent 64-bit hashes that together stand for a whole text; null counts as empty."""
    t = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7919), t, F.length(t)).alias("k2")]


def fold(col, mod: int):
    """crc32 of the id's decimal text, modulo; an id that is null is in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod)), F.lit(-1)).cast("int")


def bounded(df: DataFrame, rows: int) -> bool:
    """True if df has at most `rows` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def meet(rows: DataFrame, per: DataFrame, key: str, spread: str) -> DataFrame:
    """rows with the columns of their key in per, null for keys that are null or not there.

    per has one row for each key, whose `c` is the number of rows with it, and is read twice: it should be a written table. The
    hot keys, fewer than HOT at any size, reach their rows by broadcast; the others by a shuffle, in which hot and null
    keys' rows are dealt by `spread`, a column that tells rows apart.
    """
    values = [x for x in per.columns if x not in (key, "c")]
    hot = F.col("c") * HOT > (per.agg(F.sum("c")).first()[0] or 0)
    few = F.broadcast(per.where(hot).select(F.col(key).alias("__k"), F.struct(F.lit(True).alias("there"), *values).alias("__few")))
    rest = per.where(~hot).select(F.col(key).alias("__r"), F.xxhash64(key).alias("__s"), F.struct(F.lit(True).alias("there"), *values).alias("__rest"))
    met = rows.join(few, rows[key] == F.col("__k"), "left")
    own = F.col("__few").isNull() & F.col(key).isNotNull()
    met = met.withColumn("__key", F.when(own, F.col(key))).withColumn("__at", F.when(own, F.xxhash64(key)).otherwise(F.xxhash64(spread)))
    met = met.join(rest, (F.col("__key") == F.col("__r")) & (F.col("__at") == F.col("__s")), "left").withColumn("__got", F.coalesce("__few", "__rest"))
    return met.select(*rows.columns, *(F.col(f"__got.{x}").alias(x) for x in values))
