"""Files of a folder as rows, compact Parquet, and the few file operations that a model store needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """name, type (file or dir) and size of a folder's entries, in name order; ValueError if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise ValueError(f"no folder {path}")
    rows = sorted((s.getPath().getName(), "dir" if s.isDirectory() else "file", s.getLen()) for s in fs.listStatus(p))
    return spark.createDataFrame(rows, "name string, type string, size long")


def read_files(spark: SparkSession, path: str, block: int = 1024) -> DataFrame:
    """path, i and data: the content of files in blocks."""
    if block <= 0:
        raise ValueError("block must be positive")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    n = F.ceil(F.length("content") / block).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return rows.withColumn("i", at).select("path", "i", F.substring("content", F.col("i") * block + 1, F.lit(block)).alias("data"))


def safe_path(base: str, name: str) -> str:
    """base/name without its dots resolved away; ValueError where that leaves base."""
    parts: list[str] = []
    for x in name.split("/"):
        if x == "..":
            if not parts:
                raise ValueError(f"{name} lies outside {base}")
            parts.pop()
        elif x not in ("", "."):
            parts.append(x)
    if not parts:
        raise ValueError("a name is asked for")
    return f"{base.rstrip('/')}/{'/'.join(parts)}"


class Files:
    """Put and delete files below a folder, telling `changed(path, event)`."""

    def __init__(self, spark: SparkSession, base: str, changed: Callable[[str, str], None] | None = None):
        self.spark, self.base, self.changed = spark, base, changed or (lambda path, event: None)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, name: str, data: bytes) -> None:
        path = safe_path(self.base, name)
        p, fs = self._fs(path)
        own, _ = self._fs(path + ".tmp")
        out = fs.create(own, True)
        out.write(bytearray(data))
        out.close()
        fs.delete(p, False)
        fs.rename(own, p)
        self.changed(path, "put")

    def get(self, name: str) -> bytes:
        path = safe_path(self.base, name)
        p, fs = self._fs(path)
        if not fs.exists(p):
            raise ValueError(f"no file {name}")
        return bytes(self.spark.read.format("binaryFile").load(path).first()["content"])

    def delete(self, name: str) -> None:
        path = safe_path(self.base, name)
        p, fs = self._fs(path)
        if not fs.delete(p, False):
            raise ValueError(f"no file {name}")
        self.changed(path, "delete")


def write_compact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet for archives of samples: gzip, no dictionaries, delta-packed whole numbers, version 2 pages of 128 KiB."""
    options = {"compression": "gzip", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.page.size": str(128 << 10)}
    df.write.options(**options).mode(mode).parquet(path)
