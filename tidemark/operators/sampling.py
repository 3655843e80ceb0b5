"""Samples and splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_by_hash(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows whose ids have the smallest MD5 digests: a fixed uniform sample, by top-k in each partition."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(k)


class Reservoir:
    """Algorithm R: a uniform sample of k rows of a stream of unknown length."""

    def __init__(self, k: int, seed: int = 0):
        if k <= 0:
            raise ValueError("k must be positive")
        self.k, self.seen, self.rows = k, 0, []
        self.rng = np.random.default_rng(seed)

    def __len__(self) -> int:
        return len(self.rows)

    def add(self, row) -> None:
        self.seen += 1
        if len(self.rows) < self.k:
            self.rows.append(row)
        elif (at := int(self.rng.integers(self.seen))) < self.k:
            self.rows[at] = row

    def add_many(self, rows, width: int | None = None) -> None:
        for r in rows:
            if width is not None and len(r) != width:
                raise ValueError(f"rows must have {width} values")
            self.add(r)


def reservoir(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of min(k, n) rows: each partition keeps the k rows with the smallest random keys, then the whole does."""

    def keep(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]).append_column("__key", pa.array(rng.random(b.num_rows)))
            t = t if held is None else pa.concat_tables([held, t])
            held = t.take(pa.array(np.argsort(t.column("__key").to_numpy(), kind="stable")[:k]))
        if held is not None:
            yield from held.to_batches()

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(df.schema.fields)).add("__key", DoubleType())
    return df.mapInArrow(keep, schema).orderBy("__key").limit(k).drop("__key")


def split(df: DataFrame, key: str, val: float = 0.25, test: float = 0.25) -> DataFrame:
    """df with `split`: train, val or test in exact shares, by the rank of the id's MD5 digest.

    Digests are ranked within 4096 ranges of themselves, on the counts of the ranges before.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    marked = df.withColumn("__d", digest).withColumn("__r", F.substring("__d", 1, 3))
    counts = marked.groupBy("__r").agg(F.count("*").alias("__n"))
    total = F.sum("__n").over(Window.partitionBy())
    before = counts.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__b"), total.alias("__all"))
    place = F.row_number().over(Window.partitionBy("__r").orderBy("__d", key)) - 1
    out = marked.withColumn("__p", place).join(F.broadcast(before), "__r").withColumn("__p", F.col("__p") + F.col("__b"))
    n_test, n_val = F.floor(F.col("__all") * test), F.floor(F.col("__all") * val)
    name = F.when(F.col("__p") < n_test, "test").when(F.col("__p") < n_test + n_val, "val").otherwise("train")
    return out.withColumn("split", name).drop("__d", "__r", "__b", "__all", "__p")
