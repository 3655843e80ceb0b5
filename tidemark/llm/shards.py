"""Operator 8: shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups are summed to items: a group larger than the CHUNKS-th part of all bytes is an item by itself (fewer than
CHUNKS such groups can exist), the rest fall by hash into CHUNKS chunks. So at most 2 * CHUNKS items reach the driver
at any input size. A chunk of more than 1 / CHUNKS of all bytes is rare and each item is at most a few of those, so where
no group outweighs a shard the spread of shards, which differencing leaves well under its largest shared item, stays under
k / CHUNKS of a mean shard times those few: some 0.1 % for eight shards. Differencing keeps for each partial
partition its sums by shard; the two with the largest spread are combined in opposite order until one is left.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_keys

CHUNKS = 1 << 15
#: Rows that one task numbers, about.
ROWS_PER_PART = 20_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Shard of each item: Karmarkar-Karp for k shards. Ties go by order of the items."""
    n = len(sizes)
    shard = np.zeros(n, np.int64)
    if not n:
        return shard
    # a partial partition: its sums in falling order; slots[i] is the list of item trees in the i-th part
    heap = []
    made: list[tuple] = []
    for i, s in enumerate(sizes.tolist()):
        sums = (s,) + (0,) * (k - 1)
        made.append((i,))
        heap.append((-s, i, sums, tuple((i, 0) if p == 0 else None for p in range(k))))
    heapq.heapify(heap)
    joins: list[tuple] = []
    number = n
    while len(heap) > 1:
        _, _, a, pa = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        parts = [(a[i] + b[k - 1 - i], pa[i], pb[k - 1 - i]) for i in range(k)]
        parts.sort(key=lambda x: -x[0])
        low = parts[-1][0]
        trees = []
        for _, x, y in parts:
            if x is None or y is None:
                trees.append(x or y)
            else:
                joins.append((x, y))
                trees.append((-len(joins), 0))
        number += 1
        sums = tuple(s - low for s, _, _ in parts)
        heapq.heappush(heap, (-sums[0], number, sums, tuple(trees)))
    for part, tree in enumerate(heap[0][3]):
        stack = [tree] if tree else []
        while stack:
            i = stack.pop()[0]
            if i >= 0:
                shard[i] = part
            else:
                stack += joins[-i - 1]
    return shard


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law `bytes`.

    size is the text's UTF-8 bytes plus 1, and 1 for null. Rows of equal text share a shard; null and empty texts are
    one group. Shards differ by less than one item where no single group outweighs the mean shard. slot numbers a
    shard's rows from 0 without gaps, by hash part and then by id. Ids may be null or repeat. An empty table gives no
    rows. Other columns are not looked at. Texts themselves are never shuffled.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"), *text_keys(text))
    rows, _ = cut(rows, "sizes")
    groups, _ = cut(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    large = F.col("bytes") * chunks > total[0]
    alone = groups.where(large).select("k1", "k2", "bytes").orderBy("k1", "k2").toPandas()
    chunk = F.pmod(F.xxhash64("k1", "k2"), F.lit(chunks)).cast("int")
    shared = groups.where(~large).groupBy(chunk.alias("chunk")).agg(F.sum("bytes").alias("bytes")).orderBy("chunk").toPandas()
    of = differencing(np.concatenate([alone["bytes"].to_numpy(np.int64), shared["bytes"].to_numpy(np.int64)]), shards)
    by_chunk = np.zeros(chunks, np.int64)
    by_chunk[shared["chunk"].to_numpy(np.int64)] = of[len(alone) :]
    # both tables have at most `chunks` rows
    chunk_shard = spark.createDataFrame([(i, int(s)) for i, s in enumerate(by_chunk.tolist())], "chunk int, chunk_shard int")
    own = list(zip(alone["k1"].tolist(), alone["k2"].tolist(), of[: len(alone)].tolist(), strict=True))
    own_shard = spark.createDataFrame([(int(a), int(b), int(s)) for a, b, s in own], "k1 long, k2 long, own_shard int")
    parts = max(1, -(-rows.count() // ROWS_PER_PART))
    placed = rows.withColumn("chunk", chunk).join(F.broadcast(own_shard), ["k1", "k2"], "left").join(F.broadcast(chunk_shard), "chunk")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "chunk_shard").alias("shard"), F.pmod(F.xxhash64(F.lit(3), "doc_id", "k2"), F.lit(parts)).alias("part"), "k1")
    # number rows within (shard, part) and add the rows of the parts before
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = counts.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "k1")) - 1
    return placed.withColumn("place", place).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
