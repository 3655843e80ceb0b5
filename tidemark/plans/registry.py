"""Resources: named tables of fixed columns, sample distance and partitioning."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import LongType, ShortType, StringType, StructField, StructType, TimestampType

from tidemark.functions.timeparts import PARTITION_COLUMNS, partition_us

CODECS = ("compressed", "raw", "raw_col")


@dataclass(frozen=True)
class Resource:
    """hop_us: microseconds between samples. codec: of chunk files written for other programs; Parquet is the store's own."""

    name: str
    columns: tuple[str, ...]
    hop_us: int
    granularity: str = "hour"
    codec: str = "compressed"
    dtype: str = "int16"

    def __post_init__(self):
        partition_us(self.granularity)
        if self.hop_us <= 0 or not self.columns or len(set(self.columns)) < len(self.columns):
            raise ValueError("a resource needs a positive hop and distinct columns")
        if self.codec not in CODECS or self.dtype != "int16":
            raise ValueError(f"codec must be one of {CODECS} and dtype int16")

    @property
    def partition_columns(self) -> list[str]:
        return PARTITION_COLUMNS[self.granularity]

    @property
    def schema(self) -> StructType:
        """Of stored rows: time, number within the partition, the columns, then the partition columns."""
        own = [StructField(c, ShortType()) for c in self.columns]
        return StructType([StructField("ts", TimestampType()), StructField("row_idx", LongType()), *own, *(StructField(c, StringType()) for c in self.partition_columns)])


@dataclass
class Registry:
    resources: dict[str, Resource] = field(default_factory=dict)

    def add(self, resource: Resource) -> Resource:
        self.resources[resource.name] = resource
        return resource

    def __getitem__(self, name: str) -> Resource:
        if name not in self.resources:
            raise ValueError(f"unknown resource {name!r}")
        return self.resources[name]


#: The columns of a feature row.
FEATURES = ("orient_x", "orient_y", "orient_z", "sma", "mean_x", "mean_y", "mean_z")


def standard() -> Registry:
    """The device application's three tables and the loader's one."""
    out = Registry()
    out.add(Resource("raw", ("acc_x", "acc_y", "acc_z"), 40_000, "minute", "raw"))
    out.add(Resource("features", FEATURES, 1_000_000, "hour", "raw"))
    out.add(Resource("predictions", ("a", "b", "c", "d"), 1_000_000, "hour", "raw"))
    out.add(Resource("metrics", FEATURES, 1_000_000, "hour", "raw"))
    return out
