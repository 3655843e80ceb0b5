"""Time and partition arithmetic as column expressions; microseconds throughout, UTC sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a partition by granularity.
PARTITION_SECONDS = {"date": 86400, "hour": 3600, "minute": 60}
#: Partition columns by granularity, coarse to fine.
PARTITION_COLUMNS = {"date": ["date"], "hour": ["date", "hour"], "minute": ["date", "hour", "min"]}
#: Microseconds that DuckDB writes for an infinite time; with a minus for the other end.
INFINITE_US = (1 << 63) - 1


def partition_us(granularity: str) -> int:
    if granularity not in PARTITION_SECONDS:
        raise ValueError(f"granularity {granularity!r} is none of {sorted(PARTITION_SECONDS)}")
    return PARTITION_SECONDS[granularity] * 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def partition_start_us(us: Column, granularity: str) -> Column:
    """Start of the partition that a moment lies in; moments before 1970 too."""
    return us - F.pmod(us, F.lit(partition_us(granularity)))


def date_text(ts: Column) -> Column:
    """yyyy-mm-dd; years before 0 and beyond 9999 as they are, without a plus or leading zeros."""
    year = F.year(ts)
    return F.when(year.between(0, 9999), F.date_format(ts, "yyyy-MM-dd")).otherwise(F.concat(year.cast("string"), F.date_format(ts, "-MM-dd")))


def partition_values(us: Column, granularity: str) -> dict[str, Column]:
    """date (yyyy-mm-dd), hour and min (two digits), as far as the granularity goes."""
    ts = F.timestamp_micros(us)
    every = {"date": date_text(ts), "hour": F.date_format(ts, "HH"), "min": F.date_format(ts, "mm")}
    return {c: every[c] for c in PARTITION_COLUMNS[granularity]}


def partition_path(us: Column, granularity: str) -> Column:
    """The folders of a moment's partition; null where there is no time, infinity or -infinity where it is infinite."""
    values = partition_values(us, granularity)
    path = F.concat(*(F.concat(F.lit(f"{'/' * bool(i)}{c}="), v) for i, (c, v) in enumerate(values.items())))
    return F.when(us == INFINITE_US, "infinity").when(us == -INFINITE_US, "-infinity").otherwise(path)


def parts(ts: Column) -> dict[str, Column]:
    """The calendar parts of a moment."""
    return {"year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts).cast("int")}


def from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Unix seconds of calendar parts."""
    return F.unix_timestamp(F.make_timestamp(year, month, day, hour, minute, second))


def whole_div(a: Column, b: int) -> Column:
    """a divided by a positive whole number, rounded down, in whole numbers only."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def row_index(us: Column, granularity: str, hop_us: int) -> Column:
    """Number of the sample within its partition."""
    return whole_div(us - partition_start_us(us, granularity), hop_us)


def tenths_text(n: Column, unit: int) -> Column:
    """A whole number in units of `unit`, to one decimal place, halves up; in whole numbers throughout."""
    tenths = whole_div(n.cast("long") * 10 + unit // 2, unit)
    return F.concat(whole_div(tenths, 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def duration_text(seconds: Column) -> Column:
    """12s, 4m or 2.0h, of whole seconds."""
    minutes = whole_div(seconds.cast("long") + 30, 60).cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(minutes, F.lit("m"))).otherwise(F.concat(tenths_text(seconds, 3600), F.lit("h")))


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(tenths_text(n, 1 << 10), F.lit(" KB"))).otherwise(F.concat(tenths_text(n, 1 << 20), F.lit(" MB")))


def local_minute(ts: Column) -> Column:
    """yyyy-mm-ddThh:mm, as in a date and time field of a form."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")
