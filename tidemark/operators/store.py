"""The time-series store: partitioned Parquet tables with append, half-open range queries and a catalog."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timeparts import INFINITE_US, date_text, micros, partition_start_us, partition_us, partition_values, row_index, whole_div
from tidemark.operators.prefix import before_each
from tidemark.plans.registry import Registry, Resource
from tidemark.plans.tables import written


def with_partitions(df: DataFrame, resource: Resource, ts: str = "ts") -> DataFrame:
    """df with row_idx and the partition columns that its times give."""
    us = micros(F.col(ts))
    return df.withColumn("row_idx", row_index(us, resource.granularity, resource.hop_us)).withColumns(partition_values(us, resource.granularity))


def dense_rows(df: DataFrame, resource: Resource, ts: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows packed from the start of their partition, gaps closed: row_idx counts, and ts follows from it.

    Rows of one time go in the order of `ties`, in any without. Infinite times, which DuckDB writes as the ends of 64
    bits, count as none.
    """
    us = micros(F.col(ts))
    us = F.when(us.between(1 - INFINITE_US, INFINITE_US - 1), us)
    start = partition_start_us(us, resource.granularity)
    place = F.row_number().over(Window.partitionBy("__start").orderBy("__us", *ties)) - 1
    out = df.withColumn("__us", us).withColumn("__start", start).withColumn("row_idx", place.cast("long"))
    moved = F.timestamp_micros(F.col("__start") + F.col("row_idx") * resource.hop_us)
    return out.withColumn(ts, moved).withColumns(partition_values(F.col("__start"), resource.granularity)).drop("__us", "__start")


def in_range(df: DataFrame, resource: Resource, start_s: int, end_s: int) -> DataFrame:
    """Rows of [start_s, end_s) by the store's row arithmetic, with predicates that prune partitions.

    Of a partition that begins at p, rows (start - p) div hop to (end - p) div hop - 1 are taken, both rounded down;
    where the hop divides a second that is start <= ts < end. Such rows have start - hop < ts < end, which reaches the
    files' row groups, as their rows are in order of time.
    """
    start_s, end_s = int(start_s), int(end_s)
    us = micros(F.col("ts"))
    begin = partition_start_us(us, resource.granularity)
    low = F.greatest(F.lit(0), whole_div(F.lit(start_s * 1_000_000) - begin, resource.hop_us))
    high = whole_div(F.lit(end_s * 1_000_000) - begin, resource.hop_us)
    moment = lambda us: F.timestamp_micros(F.lit(us))
    near = (F.col("ts") > moment(start_s * 1_000_000 - resource.hop_us)) & (F.col("ts") < moment(end_s * 1_000_000))
    return df.where(partition_predicate(resource, start_s, end_s)).where(near & (F.col("row_idx") >= low) & (F.col("row_idx") < high))


def partition_predicate(resource: Resource, start_s: int, end_s: int):
    """Partitions that meet [start_s, end_s), as comparisons of partition columns alone."""
    cols = resource.partition_columns
    if end_s <= start_s:
        return F.lit(False)
    key = F.concat_ws("/", *cols) if len(cols) > 1 else F.col(cols[0])
    text = lambda s: F.concat_ws("/", *partition_values(F.lit(s * 1_000_000), resource.granularity).values())
    day = lambda s: date_text(F.timestamp_micros(F.lit(s * 1_000_000)))
    return (F.col("date") >= day(start_s)) & (F.col("date") <= day(end_s - 1)) & (key >= text(start_s)) & (key <= text(end_s - 1))


class Store:
    def __init__(self, spark: SparkSession, base: str, registry: Registry):
        self.spark, self.base, self.registry = spark, base.rstrip("/"), registry

    def path(self, name: str) -> str:
        return f"{self.base}/{self.registry[name].name}"

    def _folder(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def _partitions(self, path: str) -> list[str]:
        """Names of the partition folders in a folder, in order."""
        fs, own = self._folder(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(own) if s.isDirectory() and "=" in s.getPath().getName()) if fs.exists(own) else []

    def _exists(self, name: str) -> bool:
        return bool(self._partitions(self.path(name)))

    def newest(self, name: str) -> tuple[str, ...] | None:
        """Values of the newest partition, from the folders' names alone: one folder is listed for each column."""
        path, out = self.path(name), []
        for _ in self.registry[name].partition_columns:
            found = self._partitions(path)
            if not found:
                return None
            path = f"{path}/{found[-1]}"
            out.append(found[-1].split("=", 1)[1])
        return tuple(out)

    def partitions(self, name: str) -> list[tuple[str, ...]]:
        """Values of every partition, in order, from the folders' names alone."""
        found = [((), self.path(name))]
        for _ in self.registry[name].partition_columns:
            found = [((*values, x.split("=", 1)[1]), f"{path}/{x}") for values, path in found for x in self._partitions(path)]
        return [values for values, _ in found]

    def rows(self, name: str) -> DataFrame:
        """All rows; an empty table before the first append."""
        r = self.registry[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], r.schema)
        return self.spark.read.schema(r.schema).parquet(self.path(name))

    def append(self, name: str, df: DataFrame, start_s: int | None = None, on_late: str = "error", dense: bool = False, batch: int | None = None) -> None:
        """Append rows with their own `ts`, or samples numbered by `i` from start_s on.

        df is evaluated once, into the shared folder. batch: number of a micro-batch; one appended again replaces
        the files of its number and adds nothing, and its own partitions don't count as newer ones.

        on_late says what becomes of rows whose partition lies before the newest one stored: error or drop.
        dense packs each partition's rows from its start.
        """
        r = self.registry[name]
        if on_late not in ("error", "drop"):
            raise ValueError("on_late is error or drop")
        missing = [c for c in r.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        if "ts" not in df.columns:
            if start_s is None:
                start_s = int(self.spark.sql("select unix_timestamp()").first()[0])
            df = df.withColumn("ts", F.timestamp_micros(F.lit(int(start_s) * 1_000_000) + F.col("i").cast("long") * r.hop_us))
        out = (dense_rows if dense else with_partitions)(df.select("ts", *(F.col(c).cast("short").alias(c) for c in r.columns)), r).select(r.schema.fieldNames())
        out = written(out, "append")
        prefix = None if batch is None else f"batch-{batch:012d}-"
        if prefix:
            self._remove(name, prefix)
        key, last = F.struct(*r.partition_columns), self.newest(name)
        if last is not None:
            late = key < F.struct(*(F.lit(x) for x in last))
            if on_late == "drop":
                out = out.where(~late)
            elif out.where(late).limit(1).count():
                raise ValueError(f"rows lie in a partition before {last}")
        if not out.limit(1).count():
            if on_late == "drop":
                return
            raise ValueError("no rows to append")
        # ranges of time: a busy partition is dealt over several tasks
        ordered = out.repartitionByRange(*r.partition_columns, "ts").sortWithinPartitions(*r.partition_columns, "ts")
        conf, kind = self.spark.conf, "spark.sql.parquet.outputTimestampType"
        before = conf.get(kind)
        conf.set(kind, "TIMESTAMP_MICROS")  # the default has no statistics for ranges of time
        try:
            if prefix is None:
                ordered.write.mode("append").partitionBy(*r.partition_columns).parquet(self.path(name))
            else:
                self._publish(name, ordered, prefix)
        finally:
            conf.set(kind, before)

    def _remove(self, name: str, prefix: str) -> None:
        """Remove files of that prefix, and partition folders left without any."""

        def walk(path: str, depth: int) -> None:
            if depth:
                for x in self._partitions(path):
                    walk(f"{path}/{x}", depth - 1)
                return
            fs, own = self._folder(path)
            files = [s.getPath() for s in fs.listStatus(own)]
            mine = [f for f in files if f.getName().startswith(prefix)]
            for f in mine:
                fs.delete(f, False)
            if mine and len(mine) == len(files):
                fs.delete(own, True)

        marker = f"{self.base}/_batches/{name}/{prefix}"
        fs, own = self._folder(marker)
        if fs.exists(own):  # only a batch that was begun before has files
            walk(self.path(name), len(self.registry[name].partition_columns))

    def _publish(self, name: str, rows: DataFrame, prefix: str) -> None:
        """Write rows beside the table, then move the files in under names of that prefix."""
        columns = self.registry[name].partition_columns
        staged = f"{self.base}/_staged/{name}/{prefix}"
        rows.write.mode("overwrite").partitionBy(*columns).parquet(staged)
        fs, marker = self._folder(f"{self.base}/_batches/{name}/{prefix}")
        fs.create(marker, True).close()

        def walk(rest: str, depth: int) -> None:
            if depth:
                for x in self._partitions(staged + rest):
                    walk(f"{rest}/{x}", depth - 1)
                return
            _, there = self._folder(self.path(name) + rest)
            fs.mkdirs(there)
            for s in fs.listStatus(self._folder(staged + rest)[1]):
                final = self._folder(f"{self.path(name)}{rest}/{prefix}{s.getPath().getName()}")[1]
                if not fs.rename(s.getPath(), final):
                    raise OSError(f"{final} can't be written")

        walk("", len(columns))
        fs.delete(self._folder(staged)[1], True)

    def load_samples(self, name: str, samples: DataFrame, base_s: int) -> None:
        """Replace the table by rows (i, columns...), the i-th at base_s + i hops."""
        self.drop(name)
        self.append(name, samples, base_s)

    def query(self, name: str, start_s: int, end_s: int, columns: list[str] | None = None) -> DataFrame:
        """Rows of [start_s, end_s) in time order."""
        if end_s <= start_s:
            raise ValueError("the end must lie behind the start")
        r = self.registry[name]
        return in_range(self.rows(name), r, start_s, end_s).select("ts", "row_idx", *(columns or r.columns)).orderBy("ts")

    def counted(self, name: str, start_s: int, end_s: int, columns: list[str] | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
        """Rows of [start_s, end_s), and what an action on all of them counted, for which the function waits.

        rows_read are the rows given out, rows_skipped the other rows of the partitions that the range meets, so those
        partitions are read whole here. partitions come from folder names; bytes are the int16 columns'. plan_ms and
        total_ms are the times to plan, and from there to the call.
        """
        began = time.monotonic()
        if end_s <= start_s:
            raise ValueError("the end must lie behind the start")
        r, columns = self.registry[name], list(columns or self.registry[name].columns)
        text = lambda s: F.concat_ws("/", *partition_values(F.lit(int(s) * 1_000_000), r.granularity).values())
        low, high = self.spark.range(1).select(text(start_s), text(end_s - 1)).first()
        met = sum(low <= "/".join(values) <= high for values in self.partitions(name))
        seen, given = Observation(), Observation()
        scanned = self.rows(name).where(partition_predicate(r, start_s, end_s)).observe(seen, F.count(F.lit(1)).alias("n"))
        out = in_range(scanned, r, start_s, end_s).select("ts", "row_idx", *columns).observe(given, F.count(F.lit(1)).alias("n"))
        planned = time.monotonic()

        def counts() -> dict[str, int]:
            read = given.get["n"]
            total = round((time.monotonic() - began) * 1000)
            return {"partitions": met, "rows_read": read, "rows_skipped": seen.get["n"] - read, "bytes": read * 2 * len(columns), "plan_ms": round((planned - began) * 1000), "total_ms": total}

        return out, counts

    def last(self, name: str, seconds: int = 7200) -> DataFrame:
        """The newest rows: from `seconds` before the end of the last partition."""
        info = self.info(name).first()
        if not info["has_data"]:
            return self.rows(name).select("ts", "row_idx", *self.registry[name].columns)
        return self.query(name, max(info["start"], info["end"] - seconds), info["end"])

    def info(self, name: str) -> DataFrame:
        """One row: has_data, partitions, their bounds in epoch seconds, hop and columns, and the first and last row.

        Partitions are counted by folder; rows are read of the first and the last alone.
        """
        r, found = self.registry[name], self.partitions(name)
        if not found:
            return info(self.rows(name), r)
        ends = reduce(or_, (reduce(and_, (F.col(c) == x for c, x in zip(r.partition_columns, v, strict=True))) for v in (found[0], found[-1])))
        return info(self.rows(name).where(ends), r).withColumn("n_partitions", F.lit(len(found)).cast("long"))

    def drop(self, name: str) -> None:
        """Remove the table and what is kept of its numbered batches."""
        for path in (self.path(name), f"{self.base}/_staged/{name}", f"{self.base}/_batches/{name}"):
            fs, own = self._folder(path)
            fs.delete(own, True)


def info(rows: DataFrame, resource: Resource) -> DataFrame:
    us = micros(F.col("ts"))
    begin = partition_start_us(us, resource.granularity)
    return rows.agg(
        (F.count("*") > 0).alias("has_data"), F.countDistinct(begin).alias("n_partitions"),
        whole_div(F.min(begin), 1_000_000).alias("start"), whole_div(F.max(begin) + partition_us(resource.granularity), 1_000_000).alias("end"),
        F.lit(resource.hop_us).cast("long").alias("hop"), F.lit(",".join(resource.columns)).alias("columns"), F.min("ts").alias("first_row"), F.max("ts").alias("last_row"),
    )


def partitions_in_range(spark: SparkSession, granularity: str, start_s: int, end_s: int) -> DataFrame:
    """Every partition that [start_s, end_s) touches, whether it holds rows or not: path, start and end in seconds."""
    step = partition_us(granularity) // 1_000_000
    first, last = start_s // step, (end_s - 1) // step
    from tidemark.functions.timeparts import partition_path

    n = max(0, last - first + 1) if end_s > start_s else 0
    start = (F.col("id") + first) * step
    return spark.range(n).select(partition_path(start * 1_000_000, granularity).alias("path"), start.alias("start_s"), (start + step).alias("end_s"))


def late_rows(df: DataFrame, order: str, ts: str, granularity: str) -> DataFrame:
    """Rows that an append in `order` would refuse: their partition lies before one already seen."""
    day = partition_start_us(micros(F.col(ts)), granularity)
    # order within chunks and the maximum of the chunks before, so that no task holds all rows
    chunk = whole_div(F.col(order).cast("long"), 10_000)
    marked = df.withColumn("__p", day).withColumn("__c", chunk)
    tops = before_each(marked.groupBy("__c").agg(F.max("__p").alias("m")), "__c", "m", F.max, "__top").drop("m")
    inside = F.max("__p").over(Window.partitionBy("__c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = marked.join(tops, "__c").withColumn("__seen", F.greatest(inside, F.col("__top")))
    return out.where(F.col("__p") < F.col("__seen")).drop("__p", "__c", "__top", "__seen")
