"""Training and scoring of tree models on vectors, and the class statistics that go with them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def train_forest(df: DataFrame, label: str = "label", features: str = "features", trees: int = 10, depth: int = 5, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, seed=seed)]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction and its probability; df may be a stream."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("probability", F.array_max(vector_to_array("probability"))).drop("rawPrediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)


def clusters(df: DataFrame, k: int, features: str = "features", seed: int = 1) -> DataFrame:
    return KMeans(k=k, featuresCol=features, predictionCol="cluster", seed=seed).fit(df).transform(df)


def class_durations(df: DataFrame, key: str, ts: str, label: str) -> DataFrame:
    """Runs of equal labels in each key's time order: key, label, first and last time, rows."""
    order = Window.partitionBy(key).orderBy(ts)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(order)), 0).otherwise(1)
    runs = df.withColumn("__new", changed).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "__run", label).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("__run")


def class_shares(df: DataFrame, bucket, label: str) -> DataFrame:
    """Share of each label in each bucket of time."""
    counts = df.groupBy(bucket.alias("bucket"), label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))


def noisy_xor(spark: SparkSession, n: int = 300, flips: int = 15, seed: int = 3) -> DataFrame:
    """Two int16 columns and the label whether just one of them is positive, some labels wrong."""
    x = spark.range(n, numPartitions=1).select("id", *((F.randn(seed + i) * 255).cast("short").alias(c) for i, c in enumerate(("a", "b"))))
    wrong = F.col("id") < flips
    return x.select("id", "a", "b", (((F.col("a") > 0) != (F.col("b") > 0)) != wrong).alias("label"))
