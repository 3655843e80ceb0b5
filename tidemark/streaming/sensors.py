"""Device readings as streams: accelerometer samples and battery telemetry, on Spark's rate sources.

The readings are made from the row number alone, so a run can be repeated; a real device takes the source's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import battery_mv, battery_percent


def numbered(spark: SparkSession, rows_per_batch: int | None = None, rows_per_second: int = 25) -> DataFrame:
    """A stream of (i, ts): rows_per_second by the clock, or rows_per_batch in each micro-batch whatever the time."""
    if rows_per_batch:
        source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    else:
        source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    return source.load().select(F.col("value").alias("i"), F.col("timestamp").alias("ts"))


def accelerometer(spark: SparkSession, base_s: int, hop_us: int = 40_000, rows_per_batch: int | None = None) -> DataFrame:
    """Samples (ts, i, x, y, z): the i-th at base_s + i hops, waves of 50 and 100 samples around rest."""
    i = F.col("i")
    wave = lambda period, depth, rest: (F.round(F.sin((i % period) * (2 * 3.141592653589793 / period)) * depth) + rest).cast("short")
    ts = F.timestamp_micros(F.lit(int(base_s) * 1_000_000) + i * hop_us)
    return numbered(spark, rows_per_batch, max(1, 1_000_000 // hop_us)).select(ts.alias("ts"), "i", wave(50, 400, 0).alias("x"), wave(100, 200, 0).alias("y"), wave(50, 100, 1000).alias("z"))


def battery(spark: SparkSession, every_s: int = 10, rows_per_batch: int | None = None) -> DataFrame:
    """Telemetry (ts, mv, percent), a row for each every_s seconds of the clock or rows_per_batch in each micro-batch.

    The two register bytes fall by a millivolt a row from 4200 to 2600 and begin again.
    """
    raw = F.lit(4200) - F.col("i") % 1601
    rows = numbered(spark, rows_per_batch, 1)
    if not rows_per_batch:
        rows = rows.where(F.col("i") % every_s == 0).withColumn("i", F.floor(F.col("i") / every_s))
    mv = battery_mv(F.shiftright(raw.cast("int"), 8), raw.cast("int").bitwiseAND(F.lit(255)))
    return rows.select("ts", mv.alias("mv"), battery_percent(mv).alias("percent"))
