"""Windows over samples: by count, as the device makes them, and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import micros, whole_div
from tidemark.operators.prefix import before_each
from tidemark.plans.tables import written

#: Bytes of a partition to sort, as they are stored or estimated; most partitions, for plans of unknown size.
PART_BYTES, MOST_PARTS = 128 << 20, 1 << 18


def count_windows(n: Column | int, window: int, hop: int) -> Column:
    """How many full windows n samples give."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n < window, 0).otherwise(whole_div((n - window).cast("long"), hop) + 1).cast("long")


def number_rows(df: DataFrame, order: list[str], out: str = "r", parts: int | None = None) -> DataFrame:
    """df with the place of each row in the whole order, from 0.

    Rows are ranged over partitions, sorted there and written with their place in the partition: one shuffle, one sort.
    Only a count per partition is summed in one place. There are as many partitions as the shuffle setting or the
    table's bytes ask for. Rows that are equal in the order keep no particular order among themselves.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MOST_PARTS))
    # a row's id is its partition, shifted by 33 bits, and its place there
    ranged = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = before_each(sizes, "__part", "__n", F.sum, "__before").select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(out, place.cast("long")).drop("__part", "__before", "__id")


def explode_windows(df: DataFrame, window: int, hop: int, r: str = "r", out: str = "w") -> DataFrame:
    """One row for each window that a numbered sample belongs to: w * hop <= r < w * hop + window."""
    if window <= 0 or hop <= 0 or hop > window:
        raise ValueError("0 < hop <= window is asked for")
    first = F.greatest(F.lit(0), whole_div(F.col(r) - window + hop, hop))
    return df.withColumn(out, F.explode(F.sequence(first, whole_div(F.col(r), hop))))


def feature_columns(n: Column, sums: list[Column], spread: Column) -> list[Column]:
    """The seven features from a window's sums, in whole numbers but for the unit vector."""
    mean = [s / n for s in sums]
    size = F.sqrt(mean[0] * mean[0] + mean[1] * mean[1] + mean[2] * mean[2])
    size = F.when(size == 0, 1.0).otherwise(size)
    orient = [(m / size * 16384).cast("int").alias(f"orient_{a}") for m, a in zip(mean, "xyz", strict=True)]
    return [*orient, spread.alias("sma"), *((s / n).cast("int").alias(f"mean_{a}") for s, a in zip(sums, "xyz", strict=True))]


def window_features(samples: DataFrame, window: int = 100, hop: int = 25, r: str = "r", axes: tuple[str, str, str] = ("x", "y", "z"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Orientation, motion and mean of each full window of three-axis samples numbered by r.

    sma = sum(|n x - Sx| + |n y - Sy| + |n z - Sz|) div (32 n^2), which is the mean distance from the window's mean in
    whole numbers. A window's samples are gathered in one aggregate: at most `window` of them.
    """
    rows = explode_windows(samples.select(*keys, F.col(r).alias("r"), *(F.col(c).cast("long").alias(a) for c, a in zip(axes, "xyz", strict=True))), window, hop)
    held = rows.groupBy(*keys, "w").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz"), F.collect_list(F.struct("x", "y", "z")).alias("v"))
    held = held.where(F.col("n") == window)
    moved = F.aggregate("v", F.lit(0).cast("long"), lambda a, v: a + F.abs(F.col("n") * v["x"] - F.col("sx")) + F.abs(F.col("n") * v["y"] - F.col("sy")) + F.abs(F.col("n") * v["z"] - F.col("sz")))
    spread = F.floor(moved / (F.col("n") * F.col("n") * 32)).cast("int")
    return held.select(*keys, "w", *feature_columns(F.col("n"), [F.col("sx"), F.col("sy"), F.col("sz")], spread))


def time_windows(df: DataFrame, ts: str, width_s: int, hop_s: int, full: int | None = None, start_us: int = 0) -> DataFrame:
    """Sliding (or, with hop = width, tumbling) time windows: start, end, rows, sum and mean of `value`.

    Windows align to start_us; with `full` only windows of so many rows are given.
    """
    us = micros(F.col(ts)) - start_us
    last = whole_div(us, hop_s * 1_000_000)
    first = whole_div(us - width_s * 1_000_000, hop_s * 1_000_000) + 1
    out = df.withColumn("__w", F.explode(F.sequence(first, last))).groupBy("__w").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    start = F.col("__w") * hop_s * 1_000_000 + start_us
    out = out.select(F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + width_s * 1_000_000).alias("window_end"), "n", "total", "mean")
    return out.where(F.col("n") == full) if full else out
