"""Running totals over many groups, in two levels, so that no task holds them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeparts import whole_div

#: Groups of a run; runs are totalled in one place, so the groups of a table may be its square.
RUN = 10_000


def before_each(df: DataFrame, key: str, value: str, total: Callable[[Column], Column], out: str, run: int = RUN) -> DataFrame:
    """df, one row for each whole number `key`, with the total (F.sum, F.max, F.min) of `value` over all smaller keys.

    The first row has null. Keys are cut into runs of equal length; each run is totalled, and only the runs' totals, one
    row for RUN keys, meet in one task.
    """
    rows = df.withColumn("__run", whole_div(F.col(key).cast("long"), run))
    runs = rows.groupBy("__run").agg(total(value).alias("__t"))
    runs = runs.select("__run", total("__t").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    near = total(value).over(Window.partitionBy("__run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__near", near).join(runs, "__run").withColumn(out, _join(total, F.col("__far"), F.col("__near"))).drop("__run", "__near", "__far")


def _join(total: Callable[[Column], Column], a: Column, b: Column) -> Column:
    both = {F.sum: a + b, F.max: F.greatest(a, b), F.min: F.least(a, b)}[total]
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
