"""Operator 1: nearest neighbours by inner product from shifted space-filling curves.

Vectors are made equally long by one more component, sqrt(M^2 - |x|^2), so that the largest inner product is the
nearest point. Each ordering projects them on PLANE random directions, shifts and bends the coordinates into the unit
cube and sorts by the Hilbert index of the cell. Cut points from a sample of keys part each ordering into blocks, and
every vector is indexed in every ordering used. A query opens the blocks around its own key in each ordering; what
the windows of all orderings give is merged and ranked by the exact inner product in double precision.

How many orderings and how wide the windows is measured, not guessed: for PROBES queries the true neighbours are
found by one scan, and the cheapest choice that holds TARGET of them is used for all. Data without structure make
that nearly the whole ordering; nothing is cut off to hide it.

Equal vectors are indexed once, with their k + 1 smallest ids: no more can be among the k nearest.

Cut points are as many as the bounded sample gives. Blocks beyond GROUP vectors are split by hash and a window's queries
beyond QUERIES by hash too, so what meets in one task is bounded at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop

ORDERINGS, PLANE, BITS = 6, 3, 16
#: Distinct vectors of a block, blocks at most, sampled keys for each block.
BLOCK, BLOCKS, PER_BLOCK = 1024, 16_384, 64
PROBES, TARGET = 64, 0.96
#: Blocks that are merged at most where windows are wide.
MERGE = 16
#: Vectors and queries that meet in one task at most, about: a fixed bound at every size of the index.
GROUP, QUERIES = 1 << 16, 1 << 12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells [row, dimension] (Skilling, 2004); dimensions * bits must be under 64."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def keys(vectors: np.ndarray, longest: float, orderings: int, queries: bool) -> np.ndarray:
    """Hilbert keys [row, ordering]; queries are scaled to the common length."""
    x = np.asarray(vectors, np.float64)
    norm2 = (x * x).sum(1)
    if queries:
        x, more = x / np.sqrt(norm2)[:, None], np.zeros(len(x))
    else:
        x, more = x / longest, np.sqrt(np.maximum(0, 1 - norm2 / longest**2))
    x = np.hstack([x, more[:, None]])
    out = np.empty((len(x), orderings), np.int64)
    for o in range(orderings):
        rng = np.random.default_rng(1000 + o)
        axes = np.linalg.qr(rng.normal(size=(x.shape[1], min(PLANE, x.shape[1]))))[0]
        u = 1 / (1 + np.exp(-np.clip(1.702 * math.sqrt(x.shape[1]) * (x @ axes), -40, 40)))
        cell = (u + rng.random(axes.shape[1])) / 2 * (1 << BITS)
        out[:, o] = hilbert(cell.astype(np.int64), BITS)
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _nearest(q: np.ndarray, x: np.ndarray, rough: np.ndarray, ids: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k rows of x nearest to q; rough scores are within half the slack of them."""
    at = np.arange(len(x)) if len(x) <= k else np.flatnonzero(rough >= np.partition(rough, len(x) - k)[len(x) - k] - slack)
    exact = (x[at] * q).sum(1)
    best = _best(exact, ids[at], k)
    return at[best], exact[best]


def _expand(df: DataFrame, edges: np.ndarray, orderings: int, longest: float, dim: int, queries: bool, radius: int, subs: dict[tuple[int, int], int], parts_of: int = 1) -> DataFrame:
    """One row for each block that a vector (or a query's window) lies in: o, block, sub before df's columns.

    Each block has its sub-blocks by the vectors' hash, and `parts_of` of each by the queries' hash.
    """
    blocks = edges.shape[1] + 1
    parts = np.ones((orderings, blocks), np.int64)
    for (o, block), times in subs.items():
        parts[o, block] = times
    share = df.sparkSession.sparkContext.broadcast((edges, parts))

    def run(batches):
        cuts, split = share.value
        for b in batches:
            if not b.num_rows:
                continue
            got = keys(_matrix(b.column(b.schema.get_field_index("vec")), dim), longest, orderings, queries)
            rows, os, bs, ss = [], [], [], []
            low = b.column(b.schema.get_field_index("h1")).to_numpy()
            for o in range(orderings):
                at = np.searchsorted(cuts[o], got[:, o], side="right")
                for d in range(-radius, radius + 1):
                    here = at + d
                    ok = np.flatnonzero((here >= 0) & (here < blocks))
                    n = split[o, here[ok]]
                    if queries:  # all sub-blocks, its own part of each
                        own, each, step = (low[ok] % parts_of), n, parts_of
                    else:  # its own sub-block, all parts
                        own, each, step = (low[ok] % n) * parts_of, np.full(len(ok), parts_of), 1
                    times = np.repeat(np.arange(len(ok)), each)
                    sub = own[times] + (np.arange(len(times)) - np.repeat(np.cumsum(each) - each, each)) * step
                    ok = ok[times]
                    rows.append(ok)
                    os.append(np.full(len(ok), o, np.int32))
                    bs.append(here[ok].astype(np.int32))
                    ss.append(sub.astype(np.int32))
            take = pa.array(np.concatenate(rows))
            for a in range(0, len(take), 5000):
                part = slice(a, a + 5000)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(os)[part]), pa.array(np.concatenate(bs)[part]), pa.array(np.concatenate(ss)[part]), *(c.take(take[part]) for c in b.columns)], ["o", "block", "sub", *b.schema.names])

    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([StructField(x, IntegerType()) for x in ("o", "block", "sub")] + df.schema.fields)
    return df.mapInArrow(run, schema)


def _valid(rows: DataFrame) -> DataFrame:
    """Rows with an id and a usable vector."""
    return rows.where("vec_id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    Null, zero, non-finite vectors and null ids take no part. Vectors of each length are a space of their own, searched
    one after another: vectors of two lengths have no inner product. A query never finds its own id; equal vectors under
    other ids are found. Ties in the exact score go to the smaller id. With k or fewer candidates all are returned; a
    query without any gives no rows, as does an empty table. Repeated rows give repeated results. Other columns are not
    looked at.
    """
    rows = _valid(table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vec")))
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sorted(r["n"] for r in rows.groupBy(F.size("vec").alias("n")).count().collect())
    for i, dim in enumerate(lengths):
        found = _search(rows.where(F.size("vec") == dim) if len(lengths) > 1 else rows, dim, k, every, target)
        out = out.unionByName(found) if i else found
    return out


def _search(rows: DataFrame, dim: int, k: int, every: int, target: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(17), "vec").alias("h2"))
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    index = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index, index_path = cut(index.withColumn("low", F.col("ids")[0]), "index")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    names = queries.select("h1", "h2", F.col("vec_id").alias("query_id"))
    asked, asked_path = cut(queries.groupBy("h1", "h2").agg(F.first("vec").alias("vec")), "asked")
    norm2 = F.aggregate(F.transform("vec", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    n, longest = index.agg(F.count("*"), F.sqrt(F.max(norm2))).first()
    blocks = int(min(BLOCKS, max(1, math.ceil(n / BLOCK))))
    # cut points of each ordering, from a bounded sample
    place = F.pmod(F.xxhash64("h2"), F.lit(1 << 30))
    wanted = blocks * PER_BLOCK
    sample = index.where(place < int(min(1.0, 1.2 * wanted / n) * (1 << 30))).select("vec").limit(2 * wanted).toArrow()
    edges = np.zeros((ORDERINGS, blocks - 1), np.int64)
    if sample.num_rows and blocks > 1:
        got = np.sort(keys(_matrix(sample.column(0).combine_chunks(), dim), longest, ORDERINGS, False), axis=0)
        at = (np.arange(1, blocks) * len(got)) // blocks
        edges = np.ascontiguousarray(got[at].T)
    probes = asked.orderBy(F.xxhash64("h1", "h2")).limit(PROBES).select("vec").toArrow()
    orderings, radius = _calibrate(index, probes, edges, longest, dim, k, target)
    # wide windows open a few larger blocks instead of many
    merge = max(1, min(radius, MERGE))
    edges, radius = np.ascontiguousarray(edges[:, merge - 1 :: merge]), -(-radius // merge)
    most = min(GROUP, 4 * merge * max(BLOCK, n // blocks))
    # blocks that hold more are split by hash, and queries open all their parts
    sizes = _expand(index.select("h1", "vec"), edges, orderings, longest, dim, False, 0, {}).groupBy("o", "block").count().where(F.col("count") > most).collect()
    subs = {(r["o"], r["block"]): -(-2 * r["count"] // most) for r in sizes}
    windows = min(edges.shape[1] + 1, 2 * radius + 1)
    parts_of = -(-asked.count() * windows // ((edges.shape[1] + 1) * QUERIES))
    one = lambda df, q, r: _expand(df, edges, orderings, longest, dim, q, r, subs, max(1, parts_of))
    left = one(asked, True, radius).select("o", "block", "sub", "h1", "h2", "vec").groupBy("o", "block", "sub")
    right = one(index, False, 0).select("o", "block", "sub", "vec", "ids", "low").groupBy("o", "block", "sub")
    names_out = ["h1", "h2", "ids", "low", "score"]

    def rerank(q: pa.Table, c: pa.Table) -> pa.Table:
        empty = pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "low": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not c.num_rows:
            return empty
        x, low = _matrix(c.column("vec").combine_chunks(), dim), c.column("low").to_numpy()
        ask = _matrix(q.column("vec").combine_chunks(), dim)
        whose, which, score = [], [], []
        longest_here = np.sqrt((x * x).sum(1).max())
        slack = 4 * dim * np.finfo(float).eps * longest_here * np.sqrt((ask * ask).sum(1))
        for a in range(0, len(ask), 256):
            s = ask[a : a + 256] @ x.T
            for i in range(len(s)):
                at, exact = _nearest(ask[a + i], x, s[i], low, k + 1, slack[a + i])
                whose.append(np.full(len(at), a + i))
                which.append(at)
                score.append(exact)
        whose, which, score = np.concatenate(whose), np.concatenate(which), np.concatenate(score)
        ids = c.column("ids").combine_chunks().take(pa.array(which))
        return pa.Table.from_arrays([q.column("h1").take(pa.array(whose)), q.column("h2").take(pa.array(whose)), ids, pa.array(low[which]), pa.array(score)], names_out)

    found = left.cogroup(right).applyInArrow(rerank, "h1 long, h2 long, ids array<long>, low long, score double")
    found = found.groupBy("h1", "h2", "low").agg(F.first("ids").alias("ids"), F.first("score").alias("score"))
    by_query = Window.partitionBy("h1", "h2")
    found = found.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("score"), "low"))).where(F.col("place") <= k + 1)
    found = found.select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    found, _ = cut(found.select("h1", "h2", "vec_id", "score"), "found")
    drop(spark, index_path, asked_path)
    out = names.join(found, ["h1", "h2"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(index: DataFrame, probes: pa.Table, edges: np.ndarray, longest: float, dim: int, k: int, target: float) -> tuple[int, int]:
    """The cheapest (orderings, radius) whose windows hold `target` of the probes' true neighbours."""
    blocks = edges.shape[1] + 1
    if not probes.num_rows or blocks == 1:
        return 1, 0
    ask = _matrix(probes.column(0).combine_chunks(), dim)
    share = index.sparkSession.sparkContext.broadcast((ask, edges))

    def scan(batches):
        q, cuts = share.value
        for b in batches:
            if not b.num_rows:
                continue
            x, low = _matrix(b.column(0), dim), b.column(1).to_numpy()
            s = q @ x.T
            block = np.stack([np.searchsorted(cuts[o], c, side="right") for o, c in enumerate(keys(x, longest, ORDERINGS, False).T)], 1)
            for i in range(len(q)):
                at = _best(s[i], low, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(low[at]), pa.array(s[i][at]), pa.array(block[at].tolist(), pa.list_(pa.int64()))], ["q", "low", "score", "blocks"])

    top = index.select("vec", "low").mapInArrow(scan, "q long, low long, score double, blocks array<long>")
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low"))).where(F.col("place") <= k).toPandas()
    own = np.stack([np.searchsorted(edges[o], c, side="right") for o, c in enumerate(keys(ask, longest, ORDERINGS, True).T)], 1)
    away = np.abs(np.array(top.blocks.tolist()) - own[top.q.to_numpy()])
    best = (blocks, 1, blocks - 1)
    for o in range(1, ORDERINGS + 1):
        need = np.sort(away[:, :o].min(1))
        radius = int(need[min(len(need) - 1, math.ceil(target * len(need)) - 1)])
        cost = o * min(blocks, 2 * radius + 1)
        best = min(best, (cost, o, radius))
    return best[1], best[2]
