"""Tables on one time axis side by side: the newest row of one at each row of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeparts import micros, whole_div


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], bucket_s: int = 86_400) -> DataFrame:
    """left with the columns of the newest right row of its key at or before its time; nulls where there is none.

    Both sides meet in buckets of time, so a key with a long history is many tasks' work; what a bucket starts with
    is the last row of the buckets before, of which there is one row each.
    """
    us = micros(F.col(ts))
    value = F.struct(*columns)
    a = left.select(F.col(key).alias("__k"), us.alias("__t"), F.lit(1).alias("__side"), F.struct(F.lit(True).alias("given"), *left.columns).alias("__row"))
    b = right.select(F.col(key).alias("__k"), us.alias("__t"), F.lit(0).alias("__side"), value.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__b", whole_div(F.col("__t"), bucket_s * 1_000_000))
    ends = both.where("__side = 0").groupBy("__k", "__b").agg(F.max(F.struct("__t", "__v")).alias("e"))
    marks = both.select("__k", "__b").distinct().join(ends, ["__k", "__b"], "left")
    before = F.last("e", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = marks.select("__k", "__b", before["__v"].alias("__s"))
    inside = F.last("__v", ignorenulls=True).over(Window.partitionBy("__k", "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__in", inside).where("__side = 1").join(starts, ["__k", "__b"], "left").withColumn("__got", F.coalesce("__in", "__s"))
    return out.select(*(F.col(f"__row.`{c}`") for c in left.columns), *(F.col(f"__got.{c}").alias(f"asof_{c}") for c in columns))
