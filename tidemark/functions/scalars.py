"""Scalar functions of device telemetry, bit coding and the calculator demo."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the battery gauge: empty and full, in mV.
BATTERY_EMPTY, BATTERY_FULL = 2600, 4350


def zigzag(delta: Column, bits: int = 32) -> Column:
    """A signed difference of 32 or 64 bits as an unsigned one with small numbers for small differences: 17 bits hold those of int16 values."""
    return F.shiftleft(delta, 1).bitwiseXOR(F.shiftright(delta, bits - 1))


def unzigzag(code: Column) -> Column:
    return F.shiftrightunsigned(code, 1).bitwiseXOR(-code.bitwiseAND(F.lit(1)))


def battery_mv(high: Column, low: Column) -> Column:
    """Voltage of the two gauge registers, in mV."""
    return F.shiftleft(high.bitwiseAND(F.lit(0x3F)), 8).bitwiseOR(low)


def battery_percent(mv: Column) -> Column:
    """Linear between empty and full, cut to a whole number."""
    share = F.floor((mv - BATTERY_EMPTY) * 100 / (BATTERY_FULL - BATTERY_EMPTY)).cast("int")
    return F.when(mv <= BATTERY_EMPTY, 0).when(mv >= BATTERY_FULL, 100).otherwise(share)


def words(value: Column) -> tuple[Column, Column]:
    """The high and the low half of a 32-bit whole number, for tables and files of int16 columns."""
    return F.shiftright(value, 16).cast("short"), (value.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short")


def of_words(high: Column, low: Column) -> Column:
    return high.cast("long") * 0x10000 + low.cast("long") + 0x8000


def total(value: Column) -> Column:
    """The sum of 64-bit whole numbers; only a whole sum beyond 64 bits is an error, whatever its parts come to."""
    return F.sum(value.cast("decimal(19,0)")).cast("long")


def set_bit(value: Column, bit: int) -> Column:
    return value.bitwiseOR(F.lit(1 << bit))


def clear_bit(value: Column, bit: int) -> Column:
    return value.bitwiseAND(F.lit(~(1 << bit)))


def binary_text(value: Column) -> Column:
    """0b101 and -0b101."""
    return F.concat(F.when(value < 0, "-0b").otherwise("0b"), F.bin(F.abs(value)))


def chunk_size(argument: Column, default: int = 1024) -> Column:
    """A size given as text; the default where it is absent or not a whole number."""
    return F.coalesce(argument.try_cast("int"), F.lit(default))


def register(spark: SparkSession) -> None:
    """The demo functions as SQL functions: square, cube, is_even and bin_text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION square(v BIGINT) RETURNS BIGINT RETURN v * v")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cube_of(v BIGINT) RETURNS BIGINT RETURN v * v * v")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_even(v BIGINT) RETURNS BOOLEAN RETURN v % 2 = 0")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bin_text(v BIGINT) RETURNS STRING RETURN concat(if(v < 0, '-0b', '0b'), bin(abs(v)))")
