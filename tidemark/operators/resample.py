"""Resampling, rescaling and cleaning of float recordings on their way to int16 samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeparts import micros, whole_div

INT16 = (-32768, 32767)


def resample_mean(df: DataFrame, key: str, ts: str, columns: list[str], step_us: int) -> DataFrame:
    """Means of each key's rows in steps of time: key, bucket (start in microseconds), columns. Empty steps have no row."""
    bucket = whole_div(micros(F.col(ts)), step_us) * step_us
    return df.groupBy(key, bucket.alias("bucket")).agg(*(F.avg(c).alias(c) for c in columns)).na.drop(subset=columns)


def one_timeline(resampled: DataFrame, key: str, step_us: int) -> DataFrame:
    """The keys' recordings one after another: r counts rows by key and bucket, time_us = r * step.

    Keys are numbered apart and offset by the rows of the keys before, so no task holds more than a key.
    """
    sizes = resampled.groupBy(key).agg(F.count("*").alias("__n"))
    before = sizes.select(key, (F.sum("__n").over(Window.orderBy(key)) - F.col("__n")).alias("__b"))
    inside = F.row_number().over(Window.partitionBy(key).orderBy("bucket")) - 1
    out = resampled.withColumn("__i", inside).join(before, key)
    return out.withColumn("r", (F.col("__i") + F.col("__b")).cast("long")).withColumn("time_us", F.col("r") * step_us).drop("__i", "__b")


def to_int16(x: Column, scale: float) -> Column:
    """x / scale of full deflection, cut toward zero; raises beyond int16."""
    return (x / scale * 32767).cast("short")


def clip(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(INT16[1])), F.lit(INT16[0]))


def clipped_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: the share of values that clipping to whole int16 changes."""
    changed = lambda c: F.avg((F.col(c) != clip(F.col(c).cast("double")).cast("long")).cast("int"))
    return df.agg(*(changed(c).alias(c) for c in columns))


def group_duration(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row: keys, the sum of their greatest times, and the greatest of all."""
    per = df.groupBy(key).agg(F.max(time).alias("m"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("m").alias("total"), F.max("m").alias("longest"))
