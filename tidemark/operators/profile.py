"""How well a column of samples would pack as differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import zigzag
from tidemark.functions.timeparts import whole_div
from tidemark.operators.prefix import before_each


def with_previous(df: DataFrame, r: str, columns: list[str], chunk: int = 100_000) -> DataFrame:
    """df with p_<column>: the value of the row before in the order of r, null for the first; numbers may be left out.

    Rows are grouped in chunks of numbers; the last row of each is joined in front of the next chunk that has rows.
    """
    part = df.withColumn("__c", whole_div(F.col(r).cast("long"), chunk))
    last = part.groupBy("__c").agg(F.max(F.struct(r, *columns)).alias("__last"))
    tail = before_each(last, "__c", "__last", F.max, "__before").select("__c", *(F.col(f"__before.{c}").alias(f"__t_{c}") for c in columns))
    window = Window.partitionBy("__c").orderBy(r)
    out = part.join(tail, "__c", "left").withColumn("__first", F.row_number().over(window) == 1)
    for c in columns:
        out = out.withColumn(f"p_{c}", F.when(F.col("__first"), F.col(f"__t_{c}")).otherwise(F.lag(c).over(window)))
    return out.drop("__c", "__first", *(f"__t_{c}" for c in columns))


def long_form(df: DataFrame, r: str, columns: list[str]) -> DataFrame:
    """One row for each number and column: r, series, value."""
    return df.unpivot(r, columns, "series", "value")


def delta_profile(df: DataFrame, r: str, columns: list[str]) -> DataFrame:
    """Per column: rows, least and greatest value, and mean, median, greatest and 95th percentile of |difference|."""
    ready = with_previous(df.select(r, *columns), r, columns)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).alias("value"), F.abs(F.col(c) - F.col(f"p_{c}")).alias("delta")) for c in columns)))
    rows = ready.select(pairs.alias("s")).select("s.*")
    return rows.groupBy("series").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("delta").alias("mean_abs"),
        F.median("delta").alias("median_abs"), F.max("delta").alias("max_abs"), F.percentile("delta", F.lit(0.95)).alias("p95_abs"),
    )


def bits_needed(p95: Column) -> Column:
    """Bits of a zigzag code for differences up to p95, at least one."""
    code = F.greatest((p95 * 2).cast("long"), F.lit(1))
    return F.length(F.bin(code)).cast("int")


def compression_estimate(profile: DataFrame) -> DataFrame:
    """Per column: bits, values in a 28-bit word, bits stored for each value, ratio to 16 bits, and bytes."""
    bits = bits_needed(F.col("p95_abs"))
    out = profile.withColumn("bits", bits).withColumn("per_word", F.greatest(F.lit(1), F.expr("28 div bits").cast("int")))
    stored = F.lit(32.0) / F.col("per_word")
    return out.select("series", "n", "bits", "per_word", stored.alias("bits_stored"), (F.lit(16.0) / stored).alias("ratio"), (F.col("n") * stored / 8).alias("bytes"))


def recommendation(estimate: DataFrame) -> DataFrame:
    """One row: raw and packed bytes of all columns, their ratio, and whether packing pays."""
    out = estimate.agg((F.sum("n") * 2).cast("double").alias("raw_bytes"), F.sum("bytes").alias("packed_bytes"))
    ratio = F.col("raw_bytes") / F.col("packed_bytes")
    return out.select("raw_bytes", "packed_bytes", ratio.alias("ratio"), F.when(ratio > 1.5, "good").when(ratio > 0.9, "marginal").otherwise("worse").alias("verdict"))


def zigzag_deltas(df: DataFrame, r: str, column: str, kind: str = "int") -> DataFrame:
    """r, value, delta to the row before (0 for the first) and its zigzag code, all three int or long."""
    ready = with_previous(df.select(r, F.col(column).cast(kind).alias("value")), r, ["value"])
    delta = F.coalesce(F.col("value") - F.col("p_value"), F.lit(0).cast(kind))
    return ready.select(r, "value", delta.alias("delta"), zigzag(delta, {"int": 32, "long": 64}[kind]).alias("code"))


def undo_deltas(df: DataFrame, r: str, seed: int, chunk: int = 100_000) -> DataFrame:
    """r and value, of the differences' type, from differences and the first value: running sums within chunks, on the sums of the chunks before."""
    part = df.withColumn("__c", whole_div(F.col(r).cast("long"), chunk))
    sums = part.groupBy("__c").agg(F.sum("delta").alias("__s"))
    before = before_each(sums, "__c", "__s", F.sum, "__b").select("__c", F.coalesce("__b", F.lit(0)).alias("__b"))
    run = F.sum("delta").over(Window.partitionBy("__c").orderBy(r).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("__run", run).join(before, "__c").select(r, (F.lit(seed) + F.col("__b") + F.col("__run")).cast(df.schema["delta"].dataType).alias("value"))
