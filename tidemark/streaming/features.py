"""Structured Streaming: ingest, windows of features by time and by count, samples and late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.store import Store
from tidemark.operators.windows import feature_columns
from tidemark.plans.registry import FEATURES
from tidemark.plans.tables import written


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, on_late: str = "error") -> StreamingQuery:
    """Append each micro-batch once; late partitions stop the query (error) or are left out (drop).

    A batch is appended under its number: one that is tried again replaces what its first try left.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = written(batch, "batch")  # read once: a source may not give the same rows again
        if rows.limit(1).count():
            store.append(name, rows, on_late=on_late, batch=number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(stream: DataFrame, store: Store, raw: str, features: str, checkpoint: str, window: int = 100, hop: int = 25, predict: Callable[[DataFrame], DataFrame] | None = None, predictions: str | None = None) -> list[StreamingQuery]:
    """The whole chain of a device's samples (ts, i, x, y, z): stored raw, windowed by count, seven features stored, predicted.

    A window has the time of its last sample. predict makes rows (ts, columns of `predictions`) from feature rows. Each
    store gets each micro-batch once. `i` orders the samples. Returns the two queries.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = written(batch, "batch")  # the windows' state is moved on once
        if not rows.limit(1).count():
            return
        store.append(features, rows.select("ts", *FEATURES), on_late="drop", batch=number)
        if predict and predictions:
            store.append(predictions, predict(rows), on_late="drop", batch=number)

    rows = stream.withColumn("key", F.lit(0).cast("long"))
    found = count_features(rows, window, hop)
    named = dict(zip("xyz", store.registry[raw].columns, strict=True))
    first = ingest(stream.select("ts", *(F.col(a).cast("short").alias(c) for a, c in named.items())), store, raw, f"{checkpoint}/raw", "drop")
    second = found.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/features").trigger(availableNow=True).start()
    return [first, second]


def replay(spark: SparkSession, samples: DataFrame, folder: str, base_s: int, hop_us: int, batch_rows: int = 100_000) -> DataFrame:
    """A stream of recorded samples (i, x, y, z) as if they came from the device: the i-th at base_s + i hops.

    The samples are written in the order of i, a file for each batch_rows of them, and streamed a file at a time.
    """
    ts = F.timestamp_micros(F.lit(base_s * 1_000_000) + F.col("i").cast("long") * hop_us)
    rows = samples.select(ts.alias("ts"), F.col("i").cast("long").alias("i"), *(F.col(a).cast("short").alias(a) for a in "xyz"))
    parts = max(1, -(-rows.count() // batch_rows))
    rows.repartitionByRange(parts, "i").sortWithinPartitions("i").write.mode("overwrite").parquet(f"{folder}/files")
    # files stream by age, and those of one write may be of one age: hand them over one by one
    fs = spark._jvm.org.apache.hadoop.fs
    own = fs.Path(f"{folder}/files")
    at = own.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in at.listStatus(own) if s.getPath().getName().startswith("part-"))
    for n, x in enumerate(names):
        at.setTimes(fs.Path(f"{folder}/files/{x}"), 1_000_000_000_000 + n * 1000, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/files")


def time_features(stream: DataFrame, width: str, hop: str, full: int | None = None, delay: str = "10 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """The seven features of time windows of (ts, x, y, z); windows close when the watermark passes them.

    With `full` only windows of so many samples are given. Works on batches too.
    """
    rows = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    held = rows.groupBy(*keys, F.window("ts", width, hop)).agg(F.count("*").alias("n"), *(F.sum(F.col(a).cast("long")).alias(f"s{a}") for a in "xyz"), F.collect_list(F.struct(*(F.col(a).cast("long").alias(a) for a in "xyz"))).alias("v"))
    if full:
        held = held.where(F.col("n") == full)
    n = F.col("n")
    far = lambda v: F.abs(n * v["x"] - F.col("sx")) + F.abs(n * v["y"] - F.col("sy")) + F.abs(n * v["z"] - F.col("sz"))
    moved = F.aggregate("v", F.lit(None).cast("long"), lambda a, v: F.coalesce(a + far(v), a, far(v)))  # a sample without all three adds nothing
    spread = F.floor(moved / (n * n * 32)).cast("int")
    return held.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), n, *feature_columns(n, [F.col(f"s{a}") for a in "xyz"], spread))


def time_totals(stream: DataFrame, width: str, hop: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows and sums of `value` in sliding or tumbling windows of ts."""
    rows = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    return rows.groupBy(F.window("ts", width, hop or width)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total")


def _full_windows(seen: int, held: int, new: int, window: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows that `new` samples after `seen` others fill, and where they begin in the held and new ones."""
    first, last = max(0, (seen - window) // hop + 1), (seen + new - window) // hop
    w = np.arange(first, last + 1)
    return w, w * hop - (seen - held)


def _sum_windows(seen: int, held: np.ndarray, new: int, window: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, starts and column sums of the windows filled."""
    w, at = _full_windows(seen, len(held) - new, new, window, hop)
    sums = np.concatenate([np.zeros((1, held.shape[1]), np.int64), np.cumsum(held, 0)])
    return w, at, sums[at + window] - sums[at]


def count_windows(stream: DataFrame, window: int, hop: int, reset: str | None = None) -> DataFrame:
    """Sums of x over windows of `window` samples each `hop` samples, per key, of a stream (key, i, x).

    Samples are put in the order of i within a micro-batch and counted across batches; state holds the last
    window - 1 samples of a key. A window is given once it is full. reset names a boolean column: a key's samples
    begin anew at each row where it is true.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = np.array(held, np.int64)
        new = pd.concat(list(frames)).sort_values("i", kind="stable")
        x = new["x"].to_numpy(np.int64)
        cuts = np.flatnonzero(new[reset].to_numpy(bool)).tolist() if reset else []
        out = []
        for a, z in zip([0, *cuts], [*cuts, len(x)], strict=True):
            if a in cuts and (a or cuts[0] == 0):
                seen, held = 0, held[:0]
            held = np.concatenate([held, x[a:z]])
            w, _, total = _sum_windows(seen, held[:, None], z - a, window, hop)
            out.append(pd.DataFrame({"key": key[0], "w": w, "total": total[:, 0]}))
            seen, held = seen + z - a, held[max(0, len(held) - window + 1) :]
        state.update((seen, held.tolist()))
        yield pd.concat(out).astype({"key": "int64", "w": "int64", "total": "int64"})

    return stream.groupBy("key").applyInPandasWithState(run, "key long, w long, total long", "at long, held array<long>", "append", GroupStateTimeout.NoTimeout)


def count_features(stream: DataFrame, window: int = 100, hop: int = 25) -> DataFrame:
    """key, w, ts and the seven features of windows by count, per key, of a stream (key, ts, i, x, y, z).

    The same windows and whole numbers as operators.windows.window_features; ts is that of the window's last sample.
    State holds the last window - 1 samples of a key.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *old = state.get if state.exists else (0, [], [], [])
        new = pd.concat(list(frames)).sort_values("i", kind="stable")
        n = len(new)
        held = np.concatenate([np.array(old, np.int64).T.reshape(-1, 3), new[["x", "y", "z"]].to_numpy(np.int64)])
        w, at, sums = _sum_windows(seen, held, n, window, hop)
        moved = np.zeros(len(w), np.int64)
        for a in range(0, len(w), 1 + (1 << 20) // window):
            part = slice(a, a + 1 + (1 << 20) // window)
            rows = held[at[part, None] + np.arange(window)]
            moved[part] = np.abs(window * rows - sums[part, None, :]).sum((1, 2))
        mean = sums / window
        size = np.sqrt(mean[:, 0] * mean[:, 0] + mean[:, 1] * mean[:, 1] + mean[:, 2] * mean[:, 2])
        size[size == 0] = 1.0
        ends = new["ts"].to_numpy()[at + window - 1 - (len(held) - n)] if len(w) else new["ts"].to_numpy()[:0]
        values = [*(mean[:, j] / size * 16384 for j in range(3)), moved // (window * window * 32), *mean.T]
        out = pd.DataFrame({"key": np.full(len(w), key[0], np.int64), "w": w, "ts": ends} | {c: np.trunc(v).astype(np.int32) for c, v in zip(FEATURES, values, strict=True)})
        tail = held[max(0, len(held) - window + 1) :]
        state.update((seen + n, *(tail[:, j].tolist() for j in range(3))))
        yield out

    schema = "key long, w long, ts timestamp, " + ", ".join(f"{c} int" for c in FEATURES)
    return stream.select("key", "ts", "i", "x", "y", "z").groupBy("key").applyInPandasWithState(run, schema, "at long, x array<long>, y array<long>, z array<long>", "append", GroupStateTimeout.NoTimeout)


def reservoirs(stream: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Algorithm R per key over a stream (key, x): after each micro-batch the current sample of the keys that got rows."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = list(held)
        for f in frames:
            for x in f["x"].tolist():
                seen += 1
                if len(held) < k:
                    held.append(int(x))
                elif (at := int(np.random.default_rng((seed, int(key[0]), seen)).integers(seen))) < k:
                    held[at] = int(x)
        state.update((seen, held))
        yield pd.DataFrame({"key": key[0], "seen": seen, "x": held}).astype("int64")

    return stream.groupBy("key").applyInPandasWithState(run, "key long, seen long, x long", "seen long, held array<long>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is into an in-memory table and return that; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, mode: str, checkpoint: str, path: str) -> DataFrame:
    """Run a stream over what there is; each micro-batch is written under its own number, so a retry replaces it.

    mode complete keeps the last batch only.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
